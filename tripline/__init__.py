"""Fleet telemetry analytics as Spark DataFrame operators and report plans."""
