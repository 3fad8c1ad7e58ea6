"""Texts of the bulletins' tables, read by sources.bulletins."""
