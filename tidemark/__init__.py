"""Point-in-time feature engineering for credit tables, written as Spark DataFrame jobs."""
