"""Readers and writers of the text formats, and fixtures over the driver's tables."""
