"""Readers, writers and generators of meshes, coils and results."""
