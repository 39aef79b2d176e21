"""Device telemetry analytics on PySpark: the same DataFrame operators for tables and streams."""
