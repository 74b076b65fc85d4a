"""plumbline: data-quality and profiling operators as Spark DataFrame functions."""
