"""Column-level building blocks: the factor algebra, scalar helpers and indicators."""
