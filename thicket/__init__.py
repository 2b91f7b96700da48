"""Entity-preserving queries on Spark: nested results, entity-level paging and counting, hydrated writes."""
