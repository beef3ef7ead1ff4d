"""Structured Streaming forms of daily sales (T1) and invoice posting."""
