"""Column functions: Column in, Column out, no Python on rows."""
