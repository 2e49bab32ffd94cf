"""Plan helpers: materialised steps, global running totals, skew-safe joins, bounded blocks."""
