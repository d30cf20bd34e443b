"""quarry: workforce, finance, document and request-log analytics as PySpark DataFrame jobs.

Subpackages: ``functions`` (Column builders), ``operators`` (DataFrame -> DataFrame jobs),
``sources`` (readers and sinks), ``streaming`` (Structured Streaming jobs) and ``plans``
(bindings of the test tables to the operators, with their SQL oracles).
"""
