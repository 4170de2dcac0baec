"""Column and grouped-statistic building blocks."""
