"""Column expressions: everything here is JVM-side and stays inside code generation."""
