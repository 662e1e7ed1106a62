"""Crystal-defect analytics on Spark: DataFrame operators for atomistic frames."""
