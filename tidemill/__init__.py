"""Tidemill: web-collection analytics as DataFrame-to-DataFrame operators on Spark."""
