"""Column expressions (JVM side) and record-level parsers (Arrow batches)."""
