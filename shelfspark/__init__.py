"""Book-catalogue analytics on Spark."""
