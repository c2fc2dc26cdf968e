"""The metrics: each function takes activity rows (or a cube) and returns one table."""
