"""Point-in-time sequence analytics and training-data operators on Spark."""
