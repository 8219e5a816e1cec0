"""How natural a string is, from its characters per subword under a public vocabulary.

Words and names made of words have many characters per subword, random strings few; how many depends on length
and alphabet. For each kind of alphabet and length the distribution is measured on two samples that the vocabulary
itself gives: names composed of its words, and strings drawn from the alphabet. A string's measure is the
log-likelihood ratio of the two, positive for unnatural strings.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string

from lodestrata.llm import vocab

#: The measure is bounded, so that no length outweighs the context.
BOUND = 4.0
SAMPLES = 200
LENGTHS = (4, 6, 8, 12, 16, 24, 32, 48)
SYMBOLS = "!?#%&*+=_-/@"
ALPHABETS = {
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase + string.digits,
    "hex": string.hexdigits[:16],
    "digits": string.ascii_lowercase + string.digits,
    "mixed": string.ascii_letters + string.digits,
    "symbols": string.ascii_letters + string.digits + SYMBOLS,
}
_LOWER, _UPPER, _DIGIT = re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"\d")


def kind_of(value: str) -> str:
    """The smallest alphabet of a value."""
    bare = re.sub(r"[_.\-/ ]", "", value)
    lower, upper, digit = bool(_LOWER.search(bare)), bool(_UPPER.search(bare)), bool(_DIGIT.search(bare))
    if not bare.isalnum():
        return "symbols"
    if digit and len(bare) >= 16 and not upper and not re.search(r"[^0-9a-f]", bare):
        return "hex"
    if upper and not lower:
        return "upper"
    if upper:
        return "mixed"
    return "digits" if digit else "lower"


def _bucket(n: int) -> int:
    return max((x for x in LENGTHS if x <= n), default=LENGTHS[0])


@functools.lru_cache(maxsize=4)
def _words(path: str) -> list[str]:
    """Words of the vocabulary, which it spells with a space in front."""
    enc = vocab.encoding(path)
    found = []
    for token in enc._mergeable_ranks:
        if token[:1] == b" " and 4 <= len(token) <= 11 and token[1:].isalpha() and token[1:].islower() and token.isascii():
            found.append(token[1:].decode())
    return sorted(found) or ["word"]


def _name(rng: random.Random, words: list[str], kind: str, n: int) -> str:
    """A name of about ``n`` characters in one of the usual spellings."""
    parts: list[str] = []
    while not parts or len("-".join(parts)) < n - 2:
        parts.append(rng.choice(words))
    style = rng.randrange(4)
    text = ("_", "-", "", "")[style].join(p.capitalize() if (style == 2 or kind == "mixed") and i else p for i, p in enumerate(parts))
    if kind in ("digits", "mixed", "symbols", "upper") and rng.random() < 0.6:
        text += str(rng.randrange(10 ** rng.choice((1, 1, 2, 4))))
    return text.upper() if kind == "upper" else text


@functools.lru_cache(maxsize=4)
def _fitted(path: str) -> dict[tuple[str, int], tuple[float, float, float, float]]:
    """Mean and deviation of names and of random strings, by alphabet and length."""
    rng = random.Random(11)
    words = _words(path)

    def moments(values: list[str]) -> tuple[float, float]:
        x = [vocab.chars_per_subword(v, path) for v in values]
        mean = sum(x) / len(x)
        return mean, max(0.15, 1.3 * (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5)

    out = {}
    for kind, alphabet in ALPHABETS.items():
        for n in LENGTHS:
            names = [_name(rng, words, kind, n) for _ in range(SAMPLES)]
            drawn = ["".join(rng.choice(alphabet) for _ in range(n + rng.randrange(max(1, n // 3)))) for _ in range(SAMPLES)]
            out[kind, n] = (*moments(names), *moments(drawn))
    return out


@functools.lru_cache(maxsize=100_000)
def unnatural(value: str, path: str) -> float:
    """Log-likelihood ratio of a random string against a name made of words, within ``BOUND``."""
    if not value:
        return 0.0
    x = vocab.chars_per_subword(value, path)
    name_mean, name_dev, drawn_mean, drawn_dev = _fitted(path)[kind_of(value), _bucket(len(value))]
    if x >= name_mean:
        return -BOUND
    if x <= drawn_mean:
        return BOUND
    ratio = (x - name_mean) ** 2 / (2 * name_dev**2) - (x - drawn_mean) ** 2 / (2 * drawn_dev**2) + math.log(name_dev / drawn_dev)
    return max(-BOUND, min(BOUND, ratio))
