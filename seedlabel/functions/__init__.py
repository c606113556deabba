"""Column expressions (pure, JVM-side unless stated) used by the operators."""
