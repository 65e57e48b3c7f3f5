"""Spatial hierarchy analytics and corpus operators expressed as Spark plans."""
