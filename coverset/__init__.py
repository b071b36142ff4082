"""Representative subsets of very large tables, as Spark DataFrame operators."""
