"""Voxelith streaming."""
