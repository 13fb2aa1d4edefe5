"""Point-in-time forecasting and walk-forward evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
