"""Analyses over jobs, node samples, joined job samples and node hardware."""
