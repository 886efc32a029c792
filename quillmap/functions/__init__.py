"""Column functions; all of them are built-in expressions, so plans stay in the JVM."""
