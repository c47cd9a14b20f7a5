"""fusewright: a PySpark-native engine for chimeric-transcript analytics."""

__version__ = "0.1.0"
