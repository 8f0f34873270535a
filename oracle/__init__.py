"""The same results in DuckDB SQL, for checking only."""
