"""Photo-library analytics and training-data operators as plain PySpark DataFrame transforms."""
