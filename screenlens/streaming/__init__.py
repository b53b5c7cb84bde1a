"""The analysis as a stream."""
