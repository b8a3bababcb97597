"""Analytics on the variable parts of parsed log lines, as Spark DataFrame jobs."""
