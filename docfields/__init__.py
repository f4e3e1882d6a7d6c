"""docfields: field extraction, correction and log analytics for document text on Spark."""

__version__ = "0.1.0"
