"""Listing-data preparation and honest model evaluation as Spark DataFrame jobs."""
