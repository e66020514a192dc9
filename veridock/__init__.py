"""Evidence-grounding analytics on PySpark: tables in, tables out."""

__version__ = "0.1.0"
