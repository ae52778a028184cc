"""docslice: cuts documents into chunks and analyses them, as Spark DataFrame operators."""

__version__ = "0.1.0"
