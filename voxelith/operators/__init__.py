"""Voxelith operators."""
