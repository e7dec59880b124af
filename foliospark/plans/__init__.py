"""Declarative plans: one description of a query, as Spark SQL for the engine and as DuckDB SQL for its check."""
