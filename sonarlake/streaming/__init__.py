"""Keyed state for live streams."""
