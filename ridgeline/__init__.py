"""Medial-sheet analytics for 3D point clouds, expressed as Spark jobs."""
