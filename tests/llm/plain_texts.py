"""Made-up texts for the tests of this folder."""

import random


def prose(seed, words):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in"] + ["".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(3, 9))) for _ in range(400)]
    out = [r.choice(vocabulary) + (r.choice(".,") if r.random() < 0.12 else "") for _ in range(words)]
    return " ".join(out)


def near(text, seed):
    words = text.split(" ")
    words[seed % len(words)] = "changed"
    return " ".join(words)
