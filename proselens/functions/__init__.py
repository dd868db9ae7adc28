"""Column builders: every function returns a ``pyspark.sql.Column``."""
