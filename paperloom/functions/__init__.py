"""Column functions: expressions of built-in Spark functions, no Python on the executors."""
