"""Writers for the exchange formats and result tables."""
