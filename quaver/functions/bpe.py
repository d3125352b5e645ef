"""A byte-level BPE tokeniser whose vocabulary and merges are arguments, for at most 77 tokens."""

from __future__ import annotations

from functools import lru_cache

import regex

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", regex.I)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """A printable letter for every byte: itself where it has one, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Tokeniser:
    """Lower-cased pieces are merged by rank; a word's last symbol carries ``end``."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int], start: int, stop: int, limit: int = 77, end: str = "</w>"):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.vocabulary, self.start, self.stop, self.limit, self.end = vocabulary, start, stop, limit, end

    def merge(self, piece: str) -> list[str]:
        symbols = [byte_letters()[b] for b in piece.encode()]
        symbols[-1] += self.end
        while len(symbols) > 1:
            pairs = {(a, b) for a, b in zip(symbols, symbols[1:]) if (a, b) in self.rank}
            if not pairs:
                break
            a, b = min(pairs, key=self.rank.__getitem__)
            out, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == [a, b]:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def encode(self, text: str) -> list[int]:
        pieces = _PIECES.findall(" ".join(text.split()).lower())
        ids = [self.vocabulary[s] for p in pieces for s in self.merge(p)]
        return [self.start, *ids[: self.limit - 2], self.stop]
