"""Column expressions: every function takes and returns columns, and stays in the JVM."""
