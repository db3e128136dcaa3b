import random


def prose(seed: int, n: int, words=("the", "of", "and", "river", "stone", "walks", "under", "bright", "seven", "trees", "quiet", "morning", "turns", "glass", "north")) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(3)) + r.choice(words) for _ in range(n))
