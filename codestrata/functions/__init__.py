"""Column functions: globs, paths, fingerprints, and line alignment."""
