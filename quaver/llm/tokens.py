"""Token ids of whole texts, with a bounded cache of the ids of short units.

A text is cut before every white space character that stands alone between two others. The public
tokenizers here never join a token over such a border, so the ids of a text are those of its units one
after another. Units repeat a lot, so their ids are kept in a dictionary of bounded size; those that
are new are encoded together, as one text of many units, and its ids are dealt to the units by the bytes that tokens stand for.
A new unit of a word and marks behind it takes the ids of both, where the tokenizer sets marks apart from letters.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

_BORDER = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f]\S)")
#: What Python takes for white space and the tokenizers don't.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Marks that may stand behind a word, whose last letter is Latin-1: changes of case can end others in a mark.
_MARKS = ".,;:!?$%&#"


class UnitEncoder:
    """Encodes texts to little-endian id bytes, equal to the tokenizer's own encoding of each whole text.

    ``spaced``: a token may hold the space before a word; otherwise white space only separates words.
    ``plain_specials``: strings of special tokens in a text are ordinary text; by default they get their own ids.
    """

    def __init__(self, path: str, dtype: str, spaced: bool, entries: int = 400_000, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.dtype = np.dtype(dtype)
        self.spaced = spaced
        self.entries = entries
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        #: Bytes of text that a token stands for: its letters, one a byte, without the end of word that some vocabularies mark.
        # one word of Latin-1 letters and marks, behind one white space if tokens may hold it; no "<", with which special tokens begin
        self._plain = re.compile(r"%s[!-;=-~\xa1-\xac\xae-\xff]+" % ("[ \n]" if spaced else "")).fullmatch
        #: A unit behind which marks are encoded, for their ids.
        self.letter = " a" if spaced else "a"
        self.marks_apart = self._marks_apart()
        self.widths = np.array([len(names.get(i, "").removesuffix("</w>" if not spaced else "")) for i in range(max(names, default=0) + 1)], np.int64)

    def units(self, text: str) -> list[str]:
        words = text.split()
        plain = not any(c in text for c in _ODD)
        if not self.spaced:
            return words if plain else _BORDER.split(text)
        gaps = len(words) - 1
        if plain and "\0" not in text and text.count(" ") + text.count("\n") == gaps and len(text) == gaps + sum(map(len, words)):
            return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return _BORDER.split(text) if text else []

    def encode(self, texts: list[str | None], group_chars: int = 4 << 20) -> list[bytes]:
        """Id bytes of each text; null is empty."""
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0
        for t in texts:
            group.append(self.units(t or ""))
            held += len(t or "")
            if held > group_chars:
                out += self._encode(group)
                group, held = [], 0
        return out + self._encode(group)

    def _encode(self, group: list[list[str]]) -> list[bytes]:
        wanted: set[str] = set()
        for g in group:
            wanted.update(g)
        if len(self.known) > self.entries:  # bounded: units that aren't used again go after a while
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        fresh, marked = set(), []
        apart, latest, letter = self.marks_apart, old.get, self.letter
        for u in wanted.difference(known):
            if (ids := latest(u)) is not None:
                known[u] = ids
            elif apart and len(word := u.rstrip(_MARKS)) < len(u) and word[-1:].isalpha() and word[-1] < "\u0100" and word != letter:
                marked.append((u, word, letter + u[len(word) :]))
            else:
                fresh.add(u)
        parts = {part for _, *both in marked for part in both}
        for u in (parts | {letter} if parts else parts).difference(known):
            if (ids := latest(u)) is not None:
                known[u] = ids
            else:
                fresh.add(u)
        joint = [u for u in fresh if self._plain(u)]
        for i in range(0, len(joint), 4096):
            self._learn(joint[i : i + 4096])
        rest = [u for u in fresh if u not in known]
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for u, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[u] = np.array(e.ids, self.dtype).tobytes()
        if marked:
            begin = len(known[letter])
            for u, word, marks in marked:
                known[u] = known[word] + known[marks][begin:]
        get = known.__getitem__
        return [b"".join(map(get, g)) for g in group]

    def _marks_apart(self) -> bool:
        """Whether marks have the same ids behind other words as behind a letter, and no added token holds one."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if any(c in t.content for t in self.tokenizer.get_added_tokens_decoder().values() for c in _MARKS):
            return False
        tails = [*_MARKS, *(a + b for a in _MARKS for b in _MARKS), "...", "$$$", "%%%", "&&&", "###", "?!.,"]
        begin = len(ids(self.letter))
        return all(ids(w + t) == ids(w) + ids(self.letter + t)[begin:] for w in ("b", " ab", "É", " it's") for t in tails)

    def _learn(self, units: list[str]) -> None:
        """Keep the ids of plain units, encoded as one text. None of them is kept if ids don't end where units do."""
        text = ("" if self.spaced else " ").join(units)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        reach = np.cumsum(self.widths[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        # a gap is a unit's own first byte, or belongs to none
        ends = np.append(gaps[1:], len(raw)) if self.spaced else np.append(gaps, len(raw)) - np.arange(len(units))
        at = np.searchsorted(reach, ends, side="right")
        if not len(reach) or reach[-1] != ends[-1] or (reach[at - 1] != ends).any():
            return
        size = self.dtype.itemsize
        data, known, a = ids.tobytes(), self.known, 0
        for u, b in zip(units, (at * size).tolist()):
            known[u] = data[a:b]
            a = b


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str, spaced: bool) -> UnitEncoder:
    """One encoder for each worker process."""
    return UnitEncoder(path, dtype, spaced)


def is_spaced(path: str) -> bool:
    """Whether a word's ids depend on a space before it."""
    t = Tokenizer.from_file(path)
    return t.encode(" a", add_special_tokens=False).ids != t.encode("a", add_special_tokens=False).ids


def vocabulary_size(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
