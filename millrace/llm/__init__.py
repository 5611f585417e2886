"""Operators for training text at scale. Nothing outside this subpackage imports it."""
