"""Entity ids: a kind, 128 bits in Crockford's base 32, and where they came from."""

from __future__ import annotations

import hashlib
import os
import time
from dataclasses import dataclass

_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Kinds that always exist.
CORE_KINDS = ("decision", "plan", "label", "residual", "scope-reduction")


def _text(value: int) -> str:
    return "".join(_ALPHABET[(value >> 5 * i) & 31] for i in reversed(range(26)))


def mint(now_ms: int | None = None, random: bytes | None = None) -> str:
    """48 bits of milliseconds, then 80 random bits: text order is time order."""
    ms = int(time.time() * 1000) if now_ms is None else now_ms
    return _text((ms & (2**48 - 1)) << 80 | int.from_bytes((random or os.urandom(10))[:10], "big"))


def derived(*parts: str) -> str:
    """The same parts give the same id."""
    return _text(int.from_bytes(hashlib.sha256("\x1f".join(parts).encode()).digest()[:16], "big"))


def parse(text: str) -> int:
    if len(text) != 26 or text[0] > "7":
        raise ValueError("an id has 26 characters and 128 bits")
    value = 0
    for c in text.upper():
        c = {"O": "0", "I": "1", "L": "1"}.get(c, c)
        if c not in _ALPHABET:
            raise ValueError(f"{c!r} is not in the alphabet")
        value = value << 5 | _ALPHABET.index(c)
    return value


def millis(text: str) -> int:
    return parse(text) >> 80


@dataclass
class Registry:
    """Kinds of entities; a kind that isn't known is described as such, not refused."""

    kinds: dict[str, str]

    @classmethod
    def core(cls) -> Registry:
        return cls(dict.fromkeys(CORE_KINDS, "core"))

    def register(self, kind: str, what: str) -> None:
        if kind in self.kinds:
            raise ValueError(f"{kind!r} is registered")
        self.kinds[kind] = what

    def describe(self, kind: str) -> str:
        return self.kinds.get(kind, f"unknown kind {kind!r}")
