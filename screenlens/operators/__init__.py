"""Operators over lines, layouts, series, scenes and records."""
