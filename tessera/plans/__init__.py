"""Plan helpers: scratch tables and joins that stand skewed keys."""
