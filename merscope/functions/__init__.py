"""Column functions: base alphabet, reverse complements and k-mer hashes."""
