"""Training-data operators on Spark; nothing else in the package imports this subpackage."""
