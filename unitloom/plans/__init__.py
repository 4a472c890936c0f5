"""Declarations that travel beside a DataFrame: columns with units and formulas, rules, migrations."""
