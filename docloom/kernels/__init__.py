"""Converters from bytes to Markdown; plain Python without Spark, one call for one file."""
