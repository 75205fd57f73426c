"""Readers that turn files into the declared tables."""
