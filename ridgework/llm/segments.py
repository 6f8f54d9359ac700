"""Cutting texts where any byte-level pre-tokenizer of the usual pattern cuts too.

A pre-token holds white space only as one leading space or as a run of white space, so a single space
between two characters that are not white space always starts a new pre-token, and what lies before and
after it can be encoded separately. Segments repeat a lot, so each one is encoded once per worker.
"""

from __future__ import annotations

from collections.abc import Callable


def merged(parts: list[str]) -> list[str]:
    """The segments of " ".join(parts), joined again wherever white space is not a lone space."""
    out, cur = [], parts[0]
    for p in parts[1:]:
        if cur and p and not cur[-1].isspace() and not p[0].isspace():
            out.append(cur)
            cur = " " + p
        else:
            cur += " " + p
    out.append(cur)
    return out


class Generations:
    """A bounded cache of two generations: what is used while the young one fills up outlives the old one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def find(self, key):
        if (value := self.young.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        self.young[key] = value


class SegmentCache(dict):
    """Encoded bytes by word (the part after a lone space); None where the word can't stand alone.

    encode turns a segment into the bytes of its ids. The cache is the young one of two bounded
    generations, so its memory is bounded; results never depend on it.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = 120_000):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def keep(self, word: str, code: bytes | None) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = code

    def __missing__(self, word: str) -> bytes | None:
        code = self.old.get(word)
        if code is None:
            code = None if not word or word[0].isspace() or word[-1].isspace() else self.encode(" " + word)
        if len(word) < 200:
            self.keep(word, code)
        return code

    def text(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        if not text:
            return b""
        parts = text.split(" ")
        first = parts[0]
        if len(parts) > 1 and first and not first[-1].isspace():
            codes = list(map(self.__getitem__, parts[1:]))
            if None not in codes:
                return self.encode(first) + b"".join(codes)
        return b"".join(map(self.encode, merged(parts)))
