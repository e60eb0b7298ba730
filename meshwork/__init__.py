"""meshwork: a Spark-native engine for project coordination analytics.

Everything is expressed as DataFrame to DataFrame functions (``operators``),
Column to Column functions (``functions``), readers and writers (``sources``),
end-to-end flows (``plans``) and an optional replay over Structured Streaming
(``streaming``).  The ``llm`` subpackage holds operators for training-data
pipelines; nothing else in the library imports it.
"""
