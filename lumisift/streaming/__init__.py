"""Micro-batch streams."""
