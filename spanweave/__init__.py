"""spanweave: service dependency graphs from distributed-tracing spans, computed with Spark DataFrames."""
