"""Small texts for the tests."""

import random

WORDS = ("the of and to in that is was for on it with as his he be at by had not are but from "
         "or have an they which one you were her all she there would their we him been has").split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


EDGES = [(None, "no id here"), (None, None), (1, None), (2, ""), (3, "  \n\t \n"), (4, "one"),
         (4, "one"), (4, "two words"), (5, "Ä  ö\x00 \x1c\x85 日本語 \U0001F600 ÿ"),
         (6, "A" * 30000), (7, "x " * 20000), (8, "\n" * 500), (9, "A b\r\nC\fd\ve"),
         (2**62, "big id"), (-5, "negative id")]
