"""Relational operators and grouped kernels over trajectories, scans and maps."""
