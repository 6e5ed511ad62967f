"""Activity-feed analytics as PySpark batch and streaming jobs."""
