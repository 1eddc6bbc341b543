"""Named queries over the driver's tables, and the same results as SQL."""
