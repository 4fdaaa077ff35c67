"""loomgrid: sample-by-feature datasets and training-data quality on Spark."""
