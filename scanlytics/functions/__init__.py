"""Column expressions shared by all plans; everything here stays inside the JVM."""
