"""Column-level building blocks (all Catalyst expressions, no Python UDFs)."""
