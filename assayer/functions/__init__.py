"""Column functions: every one builds a Spark expression, none runs a job."""
