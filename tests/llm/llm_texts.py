"""Invented prose for the tests of this folder."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ner", "stu", "vex") for b in ("ba", "den", "fir", "gol", "hun", "jas", "pel")]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + (draw.choice("0123456789") if draw.random() < 0.02 else "") for _ in range(n))
