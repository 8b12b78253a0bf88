"""Text alignment, search, audit and stream tracking on Spark."""
