"""Column expressions on intervals, sequences and breakpoint edges."""
