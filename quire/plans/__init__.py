"""Named queries over the driver's tables, and the same as DuckDB SQL."""
