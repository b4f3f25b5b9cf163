"""Subpackage of lattica."""
