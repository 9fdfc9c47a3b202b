"""Column expressions: node lists, time, JSON maps, ratios, guarded statistics."""
