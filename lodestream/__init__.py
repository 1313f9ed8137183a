"""A PySpark engine that prepares and serves sample data for training."""
