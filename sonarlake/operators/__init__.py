"""Relational operators over frames, notes, sessions and vectors."""
