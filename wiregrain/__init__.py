"""wiregrain: analytics over captured HTTP traffic, written as Spark plans.

Sub-packages: ``sources`` (tables and readers), ``functions`` (column
expressions and record-level parsers), ``operators`` (DataFrame to DataFrame),
``plans`` (registered queries and their SQL), ``streaming`` (incremental
ingestion) and the optional ``llm`` (operators for text corpora).
"""

__version__ = "0.1.0"
