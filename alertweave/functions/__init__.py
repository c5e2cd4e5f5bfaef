"""Part of alertweave."""
