"""Column functions: hashing, terms, sizing; and the random numbers of fixtures."""
