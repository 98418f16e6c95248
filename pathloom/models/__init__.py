"""Generative models: flows between tiles, and trajectories of simulated agents."""
