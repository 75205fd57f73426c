"""Query catalogue over the driver tables, with the matching SQL."""
