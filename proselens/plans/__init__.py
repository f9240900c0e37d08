"""Query plans: registered queries and their DuckDB oracles."""
