"""Column expressions and small relational helpers shared by the operators."""
