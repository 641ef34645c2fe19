"""Column functions: DataFrame expressions without a shuffle."""
