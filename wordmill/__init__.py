"""wordmill: text-corpus preparation and count-based language-model evaluation on Spark.

Every operator is a function from DataFrame (plus plain parameters) to DataFrame, or from
Column to Column, built on Spark's own expressions, joins, aggregates and Structured
Streaming.
"""

__version__ = "0.1.0"
