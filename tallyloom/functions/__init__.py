"""Column functions; each takes and gives columns and stays in the JVM."""
