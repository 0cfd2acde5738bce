"""User-facing operators."""
