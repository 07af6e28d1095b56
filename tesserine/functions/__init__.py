"""Column functions: each takes and returns columns, without Python on the executors."""
