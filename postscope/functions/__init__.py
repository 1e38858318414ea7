"""Column functions (pure expressions, JVM-side, codegen friendly)."""
