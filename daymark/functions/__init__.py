"""Column expressions shared by the sources and the operators."""
