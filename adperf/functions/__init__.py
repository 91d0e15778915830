"""Column expressions used across operators (all built-in Spark functions, codegen-friendly)."""
