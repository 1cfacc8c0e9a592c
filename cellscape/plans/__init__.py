"""Whole runs over many operators."""
