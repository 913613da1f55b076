"""Feature builds, lookups, maps, vector jobs and upserts over logical tables."""
