"""Column expressions. Everything here is built-in Spark functions, so it stays in generated code."""
