"""Fit, predict and evaluation operators."""
