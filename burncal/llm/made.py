"""Labelled tokens from a generator: secrets of formats that no rule reads, and what looks like them but is none.

A corpus labels only what the rules find. The network has to tell other secrets too, so it also learns from tokens made here, put between the
characters that stand around candidates of the corpus, with the same surroundings for both labels. HELD_OUT is a format that is never learnt from: what is
found of it measures how far the network goes beyond the formats that it has seen. Runs of digits are in neither set: the rules call the longer ones secrets.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

LETTERS, DIGITS, ALNUM = string.ascii_letters, string.digits, string.ascii_letters + string.digits
UPPER_HEX, LOWER_HEX = "0123456789ABCDEF", "0123456789abcdef"


def _chars(rng: random.Random, alphabet: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(low, high or low)))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "t"]) for _ in range(rng.randint(1, 4)))


def _words(rng: random.Random, low: int, high: int) -> list[str]:
    return [_word(rng) for _ in range(rng.randint(low, high))]


def _dated(rng: random.Random) -> str:
    return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"


def _uuid(rng: random.Random) -> str:
    text = "-".join(_chars(rng, LOWER_HEX, n) for n in (8, 4, 4, 4, 12))
    return text.upper() if rng.random() < 0.3 else text


def _shape(rng: random.Random, text: str) -> str:
    """Letters of the same kinds, digits for digits."""
    return "".join(rng.choice(string.ascii_lowercase if c.islower() else string.ascii_uppercase) if c.isalpha() else rng.choice(DIGITS) if c.isdigit() else c for c in text)


HELD_OUT = "sk_live"

SECRETS: dict[str, Callable[[random.Random], str]] = {
    "prefixed": lambda r: r.choice(["ghp_", "gho_", "glpat-", "npm_", "pk_test_", "rk_prod_", "shpat_", "dop_v1_", "AIza", "SG.", "key-", f"{_word(r)}_"]) + _chars(r, ALNUM, 20, 40),
    "base64": lambda r: _chars(r, ALNUM + "+/", 32, 48) + r.choice(["", "", "=", "=="]),
    "urlsafe": lambda r: _chars(r, ALNUM + "-_", 24, 48),
    "base62": lambda r: _chars(r, ALNUM, 20, 44),
    "jwt": lambda r: "eyJ" + _chars(r, ALNUM, 15, 34) + ".eyJ" + _chars(r, ALNUM + "-_", 20, 80) + "." + _chars(r, ALNUM + "-_", 27, 43),
    "upper_hex": lambda r: _chars(r, UPPER_HEX, r.choice([24, 32, 40, 64])),
    "lower_hex": lambda r: _chars(r, LOWER_HEX, r.choice([24, 32, 40, 64])),
    "bot": lambda r: f"xox{r.choice('abp')}-{_chars(r, DIGITS, 10, 13)}-{_chars(r, DIGITS, 10, 13)}-{_chars(r, ALNUM, 20, 26)}",
    "access": lambda r: "AKIA" + _chars(r, string.ascii_uppercase + DIGITS, 16),
    HELD_OUT: lambda r: "sk_live_" + _chars(r, ALNUM, 24),
}

OTHERS: dict[str, Callable[[random.Random], str]] = {
    "uuid": _uuid,
    "path": lambda r: "/".join(_words(r, 2, 6)) + r.choice(["", "/", ".py", ".html", f".{r.randint(1, 9)}", f"/v{r.randint(1, 9)}"]),
    "url": lambda r: f"{r.choice(['https:', 'http:', 'ftp:'])}//{_word(r)}.{_word(r)}.{r.choice(['com', 'org', 'net', 'de', 'fr'])}/{'-'.join(_words(r, 1, 5))}{r.choice(['', '/', f'/{r.randint(1, 99999)}'])}",
    "mail": lambda r: f"{_word(r)}{r.choice(['.', '_', ''])}{_word(r)}{r.choice(['', str(r.randint(1, 9999))])}@{_word(r)}.{r.choice(['com', 'org', 'example.com', 'fr'])}",
    "version": lambda r: f"{_word(r)}-v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 99)}{r.choice(['', '-rc.1', '-beta.2', '+build.567'])}",
    "time": lambda r: f"{_dated(r)}T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}{r.choice(['', 'Z', '.123Z', '+02:00'])}",
    "range": lambda r: f"{_dated(r)}/{_dated(r)}",
    "camel": lambda r: "".join(w.title() for w in _words(r, 3, 6)) + r.choice(["", "", str(r.randint(1, 99))]),
    "snake": lambda r: "_".join(_words(r, 3, 6)) + r.choice(["", f"_{r.randint(1, 99)}"]),
    "constant": lambda r: "_".join(_words(r, 3, 5)).upper(),
    "kebab": lambda r: "-".join(_words(r, 3, 7)) + r.choice(["", f"-{r.randint(1, 9999)}"]),
    "module": lambda r: ".".join(_words(r, 3, 6)),
    "long word": lambda r: "".join(_words(r, 3, 6)),
    "shout": lambda r: "".join(_words(r, 3, 6)).upper(),
    "grouped": lambda r: r.choice(["-", ":", "."]).join(_chars(r, DIGITS, n) for n in r.choice([(4, 4, 4, 4), (3, 3, 4), (2, 2, 2, 2, 2, 2), (3, 1, 2, 6, 1), (3, 2, 4)])),
    "host": lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)) + f":{r.randint(1, 65535)}",
    "line": lambda r: r.choice("=-_.:/") * r.randint(12, 60),
    "sum": lambda r: "=".join([_word(r), str(r.randint(1, 10**6))]) + "." + _word(r),
    "place": lambda r: f"{r.uniform(-90, 90):.6f}/{r.uniform(-180, 180):.6f}",
}


#: What is easily taken for a secret comes so many times as often.
OFTEN = {"uuid": 14, "shout": 6, "long word": 4, "constant": 2, "snake": 2, "kebab": 2, "camel": 2}


def made(n: int, seed: int = 6, formats: dict[str, Callable[[random.Random], str]] | None = None, held_out: bool = False) -> list[tuple[str, str]]:
    """n tokens of at least 12 characters with their formats, as often as OFTEN says, the held-out one only where it is asked for."""
    rng, found = random.Random(seed), []
    source = SECRETS if formats is None else formats
    kinds = [k for k in source if held_out or k != HELD_OUT for _ in range(OFTEN.get(k, 1))]
    while len(found) < n:
        kind = kinds[len(found) % len(kinds)]
        token = source[kind](rng)
        while len(token) < 12:
            token += "-" + _word(rng)
        found.append((kind, token))
    return found
