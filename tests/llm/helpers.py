"""What several tests of this folder compute by hand."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def word_hash(word):
    total, power = 0, 1
    for byte in word.encode():
        total = (total + (byte + 1) * power) & MASK
        power = power * BASE & MASK
    return total


def alnum(text):
    """Runs of ASCII letters and digits and of all non-ASCII characters, lower-cased."""
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.translate(LOWER))


def space(text):
    return [w for w in re.split("[\t\n\x0b\x0c\r ]+", text.translate(LOWER)) if w]
