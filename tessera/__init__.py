"""tessera: search, filter, group and rank nested document collections with Spark."""
