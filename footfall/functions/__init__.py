"""Column helpers. All of them build expressions over Spark's own functions."""
