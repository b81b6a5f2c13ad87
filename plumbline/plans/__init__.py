"""Whole queries and commands, composed of the operators."""
