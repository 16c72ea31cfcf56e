"""emberline: spatial-compliance analytics as composable DataFrame functions on Spark."""

__version__ = "0.1.0"
