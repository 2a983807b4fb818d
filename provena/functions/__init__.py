"""Column expressions: bits, digests, codewords, vectors, geometry and text rules."""
