"""braidwork: durable graph runs as DataFrames, advanced in supersteps."""
