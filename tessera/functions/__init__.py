"""Column expressions: text, URLs, geography, time and scores. All stay in the JVM."""
