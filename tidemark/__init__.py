"""tidemark: a Spark-native engine for financial time series and record quality.

Layout
------
functions/  column expressions (no shuffle of their own)
operators/  DataFrame -> DataFrame operators
sources/    readers and writers
streaming/  Structured Streaming operators
plans/      the registered queries and the SQL they are checked against
"""

__version__ = "0.1.0"
