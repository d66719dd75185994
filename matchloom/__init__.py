"""Set-at-a-time candidate matching, risk scoring and audit on Spark DataFrames."""
