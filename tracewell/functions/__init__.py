"""Column expressions: scalars (``exprs``) and row-level rules (``scoring``)."""
