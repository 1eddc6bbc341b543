"""Column expressions: text normalisation, tokenising, scoring.  All of them stay inside the JVM."""
