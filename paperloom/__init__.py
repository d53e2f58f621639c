"""Document question answering and corpus building as Spark DataFrame functions."""
