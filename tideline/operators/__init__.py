"""Signals, labels, simulation and reports."""
