"""Micro-batch jobs over the intake log."""
