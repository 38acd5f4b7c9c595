"""Panel feature engineering and regression on Spark."""

__version__ = "0.1.0"
