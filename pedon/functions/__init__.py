"""Column expressions: one value per row, no shuffle, no Python at run time."""
