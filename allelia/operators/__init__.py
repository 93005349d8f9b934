"""Relational and numerical operators of association analysis."""
