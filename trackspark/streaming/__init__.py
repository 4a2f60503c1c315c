"""Verbs over streams of positions."""
