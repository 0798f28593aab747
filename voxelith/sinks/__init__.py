"""Voxelith sinks."""
