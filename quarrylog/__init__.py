"""Log analytics on Spark: DataFrame operators that parse, mask, de-duplicate, classify and report."""
