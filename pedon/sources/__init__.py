"""Readers of reports, points and perimeters."""
