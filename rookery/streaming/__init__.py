"""Structured Streaming jobs over the change log and the mutation log."""
