"""Texts for the tests."""
import random


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join("".join(random.Random(rng.randrange(vocabulary)).choices("abcdefghinorst", k=6)) for _ in range(n))
