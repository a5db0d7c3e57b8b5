"""postlens: posting analytics as PySpark DataFrame jobs."""
