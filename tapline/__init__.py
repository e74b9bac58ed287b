"""tapline: passive network-telemetry analytics on PySpark."""
