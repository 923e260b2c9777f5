"""Whole plans: from tables to graphs, and from graphs to reports."""
