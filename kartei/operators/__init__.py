"""Operators on files, folders, vectors and clusters."""
