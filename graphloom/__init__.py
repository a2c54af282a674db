"""graphloom: schema-driven property-graph ingestion, normalisation and query on Spark DataFrames."""

__version__ = "0.1.0"
