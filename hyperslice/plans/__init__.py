"""Queries over the driver's tables, and plans made on the driver from aggregated statistics."""
