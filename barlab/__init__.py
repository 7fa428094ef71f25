"""Point-in-time bar features, labels, folds, validation and gates on Spark DataFrames."""

__version__ = "0.1.0"
