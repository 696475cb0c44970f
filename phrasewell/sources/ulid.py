"""ULIDs: 48 bits of milliseconds, then 80 bits, in 26 characters that sort as the number does."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DocumentIdError

_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def encode(number: int) -> str:
    return "".join(_ALPHABET[(number >> (5 * k)) & 31] for k in range(25, -1, -1))


def check(text: str) -> str:
    """The id in its usual form; DocumentIdError if it is none."""
    upper = text.upper()
    if len(upper) != 26 or any(c not in _ALPHABET for c in upper) or upper[0] > "7":
        raise DocumentIdError(f"not a ULID: {text!r}")
    return upper


class Generator:
    """Ids that rise, also within a millisecond and if the clock goes back."""

    def __init__(self) -> None:
        self.last = 0

    def next(self) -> str:
        fresh = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10))
        self.last = fresh if fresh >> 80 > self.last >> 80 else self.last + 1
        return encode(self.last)


def column(number: Column, nonce: int, millis: int) -> Column:
    """The ULID of a row from its number within a batch; a task that runs again gives the same ids."""
    digits = lambda x: F.translate(F.lpad(F.conv(x.cast("string"), 10, 32), 8, "0"), _PLAIN, _ALPHABET)
    high = F.lit(nonce).cast("bigint") * F.lit(1 << 24) + F.shiftrightunsigned(number, 40)
    return F.concat(F.lit(encode(millis << 80)[:10]), digits(high), digits(number.bitwiseAND(F.lit((1 << 40) - 1))))
