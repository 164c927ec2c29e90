"""Set-oriented record linkage on Spark."""
