"""Profiles, the engine that runs them, valuation, and the catalogue of queries."""
