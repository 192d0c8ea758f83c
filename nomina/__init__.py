"""nomina — Spark-native payroll-transparency analytics.

Every public operator is a lazy ``DataFrame -> DataFrame`` (or ``Column ->
Column``) function built from the DataFrame / SQL / ML / Structured Streaming
APIs.  Nothing in the core runs row-at-a-time Python.
"""

__version__ = "0.1.0"
