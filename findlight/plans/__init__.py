"""Schema, query tree, its parsers, and the compiler to Columns."""
