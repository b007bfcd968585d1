"""Queries by area, over the driver's tables and literal rows, each with its SQL where SQL can express it."""
