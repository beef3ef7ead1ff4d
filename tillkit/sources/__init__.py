"""Table scans and sinks, the binding of the driver's tables, schemas, seeds."""
