"""Column functions: paths and sizes, packed numbers, hashes, colours and audio."""
