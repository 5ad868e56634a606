"""Document operators."""
