"""faultline: failure analytics for coding-agent logs, on PySpark."""

__version__ = "0.1.0"
