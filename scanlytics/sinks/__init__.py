"""Writers for the result tables."""
