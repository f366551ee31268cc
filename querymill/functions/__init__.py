"""Part of querymill."""
