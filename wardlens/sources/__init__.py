"""Reading and writing: relational tables, CSV extracts, split datasets, vectors, results and models."""
