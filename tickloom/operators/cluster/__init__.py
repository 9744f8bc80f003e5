"""Clustering of bars."""
