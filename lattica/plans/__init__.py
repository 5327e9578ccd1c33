"""Patterns and the order in which their edges are joined."""
