"""rollcall: entity resolution, reconciliation and geospatial counting as Spark DataFrame plans."""
