"""tabloom: leakage-safe analysis and modelling of tabular data as Spark jobs."""
