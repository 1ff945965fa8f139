"""Registered queries: thin contracts over the operators."""
