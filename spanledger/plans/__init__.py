"""Relations shared by several operators."""
