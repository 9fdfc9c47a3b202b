"""General DataFrame operators, independent of the telemetry schema."""
