"""Sources and sinks (S1–S12, K1–K6): Spark readers and writers plus the
column transformations that turn raw records into the engine's tables."""
