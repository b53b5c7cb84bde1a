"""Whole plans: the analysis of a table of images, and screens made from other tables."""
