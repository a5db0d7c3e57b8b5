"""Column -> Column building blocks; no function here starts a job."""
