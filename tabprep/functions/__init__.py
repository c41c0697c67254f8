"""Column expressions. All of them are Spark built-ins, so they stay inside the JVM."""
