"""Readers for the domain inputs and the stand-in views over the test tables."""
