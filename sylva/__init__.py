"""A PySpark engine for hierarchical manifests: scan, order, cut, encode, index and store trees."""
