"""Log pipeline on Spark: decode datagrams, normalise, check, enrich, store, search."""
