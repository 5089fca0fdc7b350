"""Column functions. All of them stay in the JVM unless the name says ``exact`` or ``similarity``."""
