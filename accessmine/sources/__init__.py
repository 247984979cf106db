"""Reading and writing tables, matrices, roles and reports."""
