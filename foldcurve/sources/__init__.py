"""Readers and writers of the tables an evaluation uses."""
