"""Entities, their columns, and readers and writers of tables."""
