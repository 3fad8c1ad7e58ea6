"""Operators on tables: matching, look-ups, geometry, geostatistics and the registry."""
