"""Column functions: no shuffles, no Python workers, usable in any select or filter."""
