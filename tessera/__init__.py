"""tessera: document and metric analytics on Spark.

Every operator is a function from DataFrames to a DataFrame built on Spark SQL
expressions, joins, windows and Structured Streaming.  ``tessera.plans`` binds
the operators to the driver tables; ``__spark_entry__`` only registers them.
"""

__all__ = ["session"]
