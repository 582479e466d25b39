"""Set-overlap analytics on Spark: exact, and estimated from randomised reports."""
