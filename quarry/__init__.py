"""quarry: Q&A corpus mining and semantic search as Spark DataFrame jobs.

Modules: ``sources`` (readers/writers), ``functions`` (Column -> Column text,
code and token features), ``operators`` (DataFrame -> DataFrame operators),
``plans`` (search, corpus, index and evaluation pipelines; physical-strategy
helpers), ``streaming`` (search over a stream of queries), ``catalog`` (the
checked queries behind ``__spark_entry__``).
"""

__version__ = "0.1.0"
