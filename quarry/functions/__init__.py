"""Column-level building blocks (JVM-side expressions, no Python per row)."""
