"""docloom: a Spark-native engine for clusters of related documents.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame in, DataFrame out), ``plans`` (whole
queries) and ``streaming``.  ``docloom.llm`` holds the training-data operators
and is optional: nothing outside of it imports it.
"""

__version__ = "0.1.0"
