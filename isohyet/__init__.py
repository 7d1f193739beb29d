"""Panel forecasting analytics expressed as PySpark DataFrame programs."""

__version__ = "0.1.0"
