"""ledgerlens: bank-ledger text analytics on Spark.

Subpackages: ``sources`` (CSV ledgers, shared tables, model tables),
``functions`` (column expressions), ``operators`` (DataFrame operators),
``plans`` (end-to-end jobs and the registered queries), ``streaming``.
"""

__version__ = "0.1.0"
