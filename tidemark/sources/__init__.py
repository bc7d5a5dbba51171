"""Reading source tables and files, writing extracts."""
