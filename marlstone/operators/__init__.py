"""Windowed features and the run store."""
