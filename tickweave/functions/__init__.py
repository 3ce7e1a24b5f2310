"""Part of tickweave."""
