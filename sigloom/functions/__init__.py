"""Column functions: arithmetic on a read's arrays, and on its sequence. All stay in the JVM."""
