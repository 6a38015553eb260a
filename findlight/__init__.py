"""findlight: search-style analytics over document and record tables, as Spark plans."""

__version__ = "0.1.0"
