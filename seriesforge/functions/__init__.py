"""Part of the series engine."""
