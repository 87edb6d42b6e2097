"""Column functions: every function maps Columns to Columns and stays inside Catalyst."""
