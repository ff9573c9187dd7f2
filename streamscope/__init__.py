"""Delivery analytics for live-media fleets, as Spark jobs."""
