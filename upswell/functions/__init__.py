"""Column-expression building blocks (all JVM-side, no Python UDFs)."""
