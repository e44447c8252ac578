"""Tessera: people-and-publications analytics and training-data preparation on plain PySpark."""
