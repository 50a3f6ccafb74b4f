"""Passwords: making them, and a plain estimate of how many guesses one withstands.

The estimate is this library's own: the password is cut into known words, repeats, runs of neighbours and single
characters so that the product of their guesses is least. It makes no claim to equal any other estimator.
"""

from __future__ import annotations

import math
import secrets

#: Alphabets without characters that look alike.
GROUPS = {"upper": "ABCDEFGHJKLMNPQRSTUVWXYZ", "lower": "abcdefghijkmnopqrstuvwxyz", "number": "23456789", "symbol": "!@#$%^&*()-_=+[]{}?"}
#: Words that guessers try first, and rows of the keyboard.
COMMON = ("password", "qwerty", "letmein", "welcome", "admin", "dragon", "monkey", "iloveyou", "login", "master", "secret", "football", "baseball", "sunshine", "princess", "shadow", "passw0rd", "hello", "freedom", "whatever")
RUNS = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "qwertyuiop", "asdfghjkl", "zxcvbnm")


def generate(length: int, groups: list[str]) -> str:
    """A password with a character of each group at least, in random order, from the system's random source."""
    if not groups:
        return ""
    made = [secrets.choice(g) for g in groups] + [secrets.choice("".join(groups)) for _ in range(length - len(groups))]
    secrets.SystemRandom().shuffle(made)
    return "".join(made[:length])


def guesses(password: str) -> float:
    """About how many guesses find the password."""
    low = password.lower()
    alphabet = sum(n for n, has in ((26, any(c.islower() for c in password)), (26, any(c.isupper() for c in password)), (10, any(c.isdigit() for c in password)), (33, any(not c.isalnum() for c in password))) if has)
    best = [0.0] + [math.inf] * len(password)  # logarithms
    for i in range(len(password)):
        steps = [(1, math.log(max(2, alphabet)))]
        for rank, word in enumerate(COMMON, 1):
            if low.startswith(word, i):
                steps.append((len(word), math.log(rank + 1) + (0 if password[i : i + len(word)] == word else math.log(2))))
        for k in range(3, len(password) - i + 1):
            part = low[i : i + k]
            if any(part in r or part[::-1] in r for r in RUNS):
                steps.append((k, math.log(8 * k)))
            if len(set(part)) == 1:
                steps.append((k, math.log(max(2, alphabet) * k)))
        for k, cost in steps:
            best[i + k] = min(best[i + k], best[i] + cost)
    return math.exp(min(best[-1], 700.0))


def strength(password: str) -> dict:
    """bits (log2 of the guesses) and score: 0 under 10^3 guesses, 1 under 10^6, 2 under 10^8, 3 under 10^10, else 4."""
    n = guesses(password)
    return {"bits": math.log2(max(1.0, n)) if password else 0.0, "score": sum(n >= 10**k for k in (3, 6, 8, 10)) if password else 0}


def crack_time(seconds: float) -> tuple[str, int]:
    """The bucket of a time and how many of its unit."""
    if not math.isfinite(seconds) or seconds >= 100 * 365 * 86_400:
        return "century", 1
    if seconds < 1:
        return "under a second", 0
    for unit, size, top in (("seconds", 1, 60), ("minutes", 60, 3_600), ("hours", 3_600, 86_400), ("days", 86_400, 365 * 86_400)):
        if seconds < top:
            return unit, max(1, math.floor(seconds / size + 0.5))
    return "years", math.floor(seconds / (365 * 86_400) + 0.5)
