"""Invented words, as in the documents of the other fixtures."""

from __future__ import annotations

import random


def words(rng: random.Random, n: int) -> str:
    syllables = ["an", "er", "th", "in", "re", "he", "st", "ou", "ing", "ble", "ti", "on"]
    out = []
    for k in range(n):
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        out.append(w.capitalize() if k % 9 == 0 else w + ("." if k % 9 == 8 else ""))
    return " ".join(out)
