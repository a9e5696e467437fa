"""Sports-statistics analytics on PySpark: page ingest, keyed merge, leaderboards, telemetry."""
