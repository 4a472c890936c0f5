"""Operators over DataFrames: tables, rules, nested values, texts, documents, images, chains and migrations."""
