"""Readers and writers of bars, universes and stored points."""
