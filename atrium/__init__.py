"""Spatial scene analytics on PySpark: posed frames, meshes, planes, rooms and layouts."""
