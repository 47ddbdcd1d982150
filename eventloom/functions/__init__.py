"""Column helpers; all are built-in Spark expressions, none is a Python UDF."""
