"""lobspark: limit-order-book analytics as lazy PySpark plans."""

__version__ = "0.1.0"
