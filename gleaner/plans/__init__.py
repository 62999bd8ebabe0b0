"""Whole plans and their queries."""
