"""Unit-aware, self-describing tables and documents on Spark."""
