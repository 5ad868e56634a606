"""Catalogue tables, change feeds and document stores."""
