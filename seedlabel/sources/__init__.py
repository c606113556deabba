"""Readers and writers for the formats the labelling workflow exchanges."""
