"""Part of the lodestone analytics engine."""
