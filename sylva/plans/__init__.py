"""Trees derived from tables, and the queries over them."""
