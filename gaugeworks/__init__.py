"""A telemetry analytics engine on Spark DataFrames."""
