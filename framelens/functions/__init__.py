"""Part of the framelens engine."""
