"""Nested artist and album documents from a normalised media catalogue, on Spark."""
