"""Writers for result, aggregate, summary and history tables."""
