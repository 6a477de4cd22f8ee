"""Date-range cover, the rollup warehouse and the reports."""
