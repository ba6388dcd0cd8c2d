"""packframe: structured data as compact, model-readable text, on Spark."""
