"""corvane: code and text retrieval, index maintenance and evaluation on PySpark."""

__version__ = "0.1.0"
