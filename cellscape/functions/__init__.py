"""Column-level functions: geometry, lattice, antenna, text, scoring."""
