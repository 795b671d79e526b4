"""Column functions: text normalisation, predicates, signals."""
