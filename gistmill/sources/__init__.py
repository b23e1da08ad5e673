"""Readers and writers for records, predictions, metrics and run history."""
