"""Logical plans and their registry."""
