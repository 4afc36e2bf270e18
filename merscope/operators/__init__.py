"""DataFrame operators: segments, tiles, k-mers, counts, sketches, estimates."""
