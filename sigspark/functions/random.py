"""Random DNA of fixtures: letters of the minimal standard generator."""

from __future__ import annotations


def random_sequence(size: int, seed: int) -> str:
    """Letters of x <- 16807 x mod 2^31 - 1; a seed that is 0 modulo 2^31 - 1 counts as 1."""
    x, out = seed % 2147483647 or 1, []
    for _ in range(size):
        x = x * 16807 % 2147483647
        out.append("ACGT"[x % 4])
    return "".join(out)
