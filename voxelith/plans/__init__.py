"""Voxelith plans."""
