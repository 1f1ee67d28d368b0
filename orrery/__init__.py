"""orrery: DataFrame operators for spatial media, and for training-data preparation, on Spark."""
