"""tessel: a relational analytics engine expressed in Spark's DataFrame and SQL APIs."""
