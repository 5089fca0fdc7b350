"""Made-up texts for the tests."""

import random


def prose(seed: int, n: int, stem: str = "") -> str:
    rng = random.Random(seed)
    return " ".join(stem + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
