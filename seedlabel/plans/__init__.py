"""Query catalogue: named end-to-end queries over the input tables, each with
an equivalent SQL text (DuckDB dialect) used as an independent oracle."""
