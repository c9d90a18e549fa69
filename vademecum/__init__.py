"""Batch jobs on Spark that turn paginated reference handbooks into checked, searchable tables."""
