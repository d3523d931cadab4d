"""Column functions that need no Python on the executors."""
