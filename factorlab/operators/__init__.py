"""Targets, indicators, factors, signals, their evaluation and selection. Each takes a DataFrame of bars and returns one."""
