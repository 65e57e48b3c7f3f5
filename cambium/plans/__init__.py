"""Plan-level helpers: shared scratch tables and iteration with bounded lineage."""
