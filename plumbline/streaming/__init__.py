"""Windowed state over event streams; every job also has a batch form over the same columns."""
