"""Factor research on large stock panels, written as Spark DataFrame functions."""
