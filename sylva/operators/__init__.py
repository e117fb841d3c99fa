"""Operators on trees: entries, filters, sums, parts, node numbers and documents."""
