"""larkspur: text retrieval, web analytics and record processing as Spark plans."""

__version__ = "0.1.0"
