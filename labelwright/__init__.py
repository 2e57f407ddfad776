"""A PySpark engine that prepares texts, labels them and measures how far the labels can be trusted."""
