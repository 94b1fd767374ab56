"""Evidence analytics on Spark: sources, table and time-series operators, risk, forecasts, graph retrieval."""
