"""Whole plans from images to pixels."""
