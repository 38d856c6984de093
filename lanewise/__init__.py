"""Trade intelligence analytics on Spark: shipments, organisations, corridors, lanes, risk and serving views."""
