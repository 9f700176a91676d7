"""Fixtures come from the tests' top folder."""
