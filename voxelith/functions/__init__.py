"""Voxelith functions."""
