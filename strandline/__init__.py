"""Structural-variant analytics as composable DataFrame -> DataFrame functions."""
