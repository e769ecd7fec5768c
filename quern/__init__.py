"""quern: exact k-mer retrieval over sequence collections, expressed as Spark DataFrames."""

__version__ = "0.1.0"
