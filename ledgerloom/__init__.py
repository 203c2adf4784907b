"""Document-to-table extraction and reconciliation on Spark DataFrames."""
