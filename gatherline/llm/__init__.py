"""Operators for preparing large text collections."""
