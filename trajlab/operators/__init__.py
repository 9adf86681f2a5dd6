"""Operators over frames of experiments, runs, steps and vectors."""
