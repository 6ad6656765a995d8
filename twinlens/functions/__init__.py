"""Part of twinlens."""
