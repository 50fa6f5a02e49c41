"""Scans and sinks: CSV batches, JSON reference tables, pages, versioned tables."""
