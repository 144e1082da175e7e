"""Column expressions: they stay inside the JVM."""
