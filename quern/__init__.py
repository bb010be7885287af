"""quern: a PySpark-native engine for listing, filing and document data."""

__version__ = "0.1.0"
