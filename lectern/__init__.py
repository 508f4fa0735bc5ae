"""Spark jobs for translating document collections while keeping their format."""
