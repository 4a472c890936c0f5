"""Units, formulas and scalar functions."""
