"""Multichannel signal analytics and corpus operators on Spark."""
