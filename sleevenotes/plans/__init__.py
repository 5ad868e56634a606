"""Entities and the build plans over them."""
