"""veritab: spec-driven table reconciliation and corpus preparation on PySpark."""

__version__ = "0.1.0"
