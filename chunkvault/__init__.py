"""chunkvault: content-addressed snapshots of byte-addressed data, on PySpark DataFrames."""

__version__ = "0.2.0"
