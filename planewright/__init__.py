"""Planar geometry and text-corpus analytics expressed as Spark DataFrame operations."""
