"""Voxelith sources."""
