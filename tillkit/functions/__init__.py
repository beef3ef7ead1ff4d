"""Column-expression builders: exact money math, predicates, formats, ordering."""
