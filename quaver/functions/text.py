"""Text functions: folding, words, routes, checks of paths and URLs, query review, strict JSON."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def fold_text(value: str | None) -> str:
    """Compatibility decomposition without marks, in lower case; null is ''."""
    if value is None:
        return ""
    return "".join(c for c in unicodedata.normalize("NFKD", value) if unicodedata.category(c)[0] != "M").lower()


@F.pandas_udf(StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(fold_text)


def fold(c: Column) -> Column:
    """``fold_text`` of a column; ASCII never leaves the JVM."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^[\x00-\x7F]*\z"), F.lower(F.coalesce(c, F.lit("")))).otherwise(_fold(c))


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def contains_all(text: Column, query: str) -> Column:
    """Whether the text has every word of the (folded) query as a substring."""
    out = F.lit(True)
    for w in query.split():
        out = out & text.contains(w)
    return out


def audio_route(ident: Column) -> Column:
    """``fma:N`` as /audio/NNNNNN.mp3; null for other ids."""
    n = F.regexp_extract(ident, r"^fma:([0-9]{1,9})\z", 1)
    return F.when(n != "", F.format_string("/audio/%06d.mp3", F.when(n != "", n.cast("int"))))


# The five characters and their references.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def html_escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_confined(path: Column) -> Column:
    """A relative path of plain names: no empty, dot or dot-dot part, backslash or NUL."""
    return (
        path.isNotNull()
        & (path != "")
        & ~path.startswith("/")
        & ~path.rlike(r"[\\\x00]")
        & F.forall(F.split(path, "/"), lambda p: (p != "") & (p != ".") & (p != ".."))
    )


def is_https_origin(url: Column) -> Column:
    return url.rlike(r"^https://[A-Za-z0-9.-]+(:[0-9]{1,5})?\z")


def is_source_url(url: Column) -> Column:
    """http or https with a host and without credentials."""
    return url.rlike(r"^https?://[^/?#@\s]+([/?#]\S*)?\z")


# Patterns of identities.
PATTERNS = {
    "sha256": r"^[a-f0-9]{64}\z",
    "code": r"^[A-Z][A-Za-z0-9.:+_-]{0,47}\z",
    "contact": r"^[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}\z",
    "track": r"^fma:[0-9]{1,9}\z",
    "uuid4": r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z",
    "rfc3339": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z\z",
}

# The words by which a description asks for something that a search can't honour.
LANGUAGES = (
    "English Spanish French German Italian Portuguese Japanese Korean Chinese Mandarin Cantonese Hindi Arabic Russian Turkish"
    " Hebrew Persian Swedish Norwegian Danish Finnish Polish Dutch Greek Vietnamese Thai Indonesian Swahili Latin"
)
WORD_CLASSES = {
    "number": "one two three four five six seven eight nine ten thirty sixty",
    "unit": "minute minutes min mins second seconds sec secs",
    "piece": "long track tracks song songs recording recordings",
    "bound": "under over about around exactly less~than more~than at~least at~most",
    "language": LANGUAGES.lower(),
    "sung": "lyrics vocals singing language only",
    "refusal": "no not without",
    "exclusion": "no without exclude excluding",
    "inclusion": "with include including",
    "sex": "female male",
    "singing": "vocal vocals singing lyrics",
    "voice": "voice voices",
    "singer": "vocal vocals voice voices singer singers singing",
    "wordless": "instrumental wordless",
    "instrumental": "instrumental instrumentals",
}
# A phrase is a row of classes or words; ? marks one that may be absent. Of several, the first that fits counts.
PHRASES = {
    "duration": ("bound number unit", "number unit piece"),
    "language": ("refusal? in language", "refusal? language sung", "refusal? only language", "non english"),
    "vocals": ("exclusion any? singing", "exclusion any? voice", "inclusion sex? singing", "sex singer", "instrumental only", "only instrumental", "wordless"),
}
_CLASSES = {name: frozenset(words.split()) for name, words in WORD_CLASSES.items()}
_PIECE = re.compile(r"\d+\.\d+|\d+|[^\W\d]\w*", re.A)


class _Words:
    """The words of a text, with the phrases that start at each."""

    def __init__(self, text: str):
        self.text = text
        self.pieces = [(m[0].lower(), m.start(), m.end()) for m in _PIECE.finditer(text)]

    def _gap(self, i: int) -> str:
        """What stands between word i - 1 and word i."""
        return self.text[self.pieces[i - 1][2] : self.pieces[i][1]] if 0 < i < len(self.pieces) else ""

    def _joined(self, i: int, kind: str, before: str | None) -> bool:
        """Whether word ``i`` may follow a word of the class ``before``."""
        gap = self._gap(i)
        if before is None:  # the phrase starts on the border of a word
            return not (i and not gap)
        if kind == "unit":  # a hyphen, spaces, both or nothing
            return gap.strip() in ("", "-")
        return gap in (" ", "-") if before == "non" else bool(gap) and gap.isspace()

    def _after(self, i: int, kind: str, before: str | None) -> int | None:
        """The word behind one of this class at word ``i``."""
        if i >= len(self.pieces) or not self._joined(i, kind, before):
            return None
        word = self.pieces[i][0]
        if word in _CLASSES.get(kind, (kind,)) or kind == "number" and word[0].isdigit():
            return i + 1
        pair = f"{word}~{self.pieces[i + 1][0]}" if i + 1 < len(self.pieces) and self._gap(i + 1).isspace() else ""
        return i + 2 if pair in _CLASSES.get(kind, ()) else None

    def _end(self, i: int, kinds: list[str], before: str | None = None) -> int | None:
        if not kinds:
            return i
        kind = kinds[0].rstrip("?")
        behind = self._after(i, kind, before)
        found = None if behind is None else self._end(behind, kinds[1:], kind)
        return self._end(i, kinds[1:], before) if found is None and kinds[0].endswith("?") else found

    def phrases(self, field: str):
        """(start, end) of the phrases of a field, which don't overlap."""
        i = 0
        while i < len(self.pieces):
            ends = (self._end(i, phrase.split()) for phrase in PHRASES[field])
            end = next((e for e in ends if e is not None), None)
            if end is not None:
                yield self.pieces[i][1], self.pieces[end - 1][2]
            i = end or i + 1


def review_query(text: str) -> list[dict]:
    """Requests that a search can't honour, by place (UTF-16 offsets), then field."""
    units = lambda s: len(s.encode("utf-16-le", "surrogatepass")) // 2
    words = _Words(text)
    found = [
        {"field": field, "source_text": text[a:b], "start": units(text[:a]), "end": units(text[:b])}
        for field in PHRASES
        for a, b in words.phrases(field)
    ]
    return sorted(found, key=lambda r: (r["start"], r["field"]))


REVIEW_TYPE = ArrayType(StructType([StructField("field", StringType()), StructField("source_text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(REVIEW_TYPE)
def query_limits(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [] if v is None else review_query(v))


def canonical_json_sha(value: str) -> str:
    """SHA-256 of the JSON text with sorted keys and no spaces, other characters kept."""
    return hashlib.sha256(json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def strict_json_problem(value: str | None) -> str | None:
    """Why a JSON text is refused (duplicate keys, NaN or infinite numbers, lone surrogates, syntax), or None."""

    class Refused(ValueError):
        pass

    def pairs(items):
        seen = dict(items)
        if len(seen) != len(items):
            raise Refused("duplicate key")
        return seen

    def constant(_):
        raise Refused("not finite")

    def number(s):
        x = float(s)
        if x in (float("inf"), float("-inf")):
            raise Refused("not finite")
        return x

    if value is None:
        return "null"
    try:
        parsed = json.loads(value, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
        json.dumps(parsed, ensure_ascii=False).encode()
    except Refused as e:
        return str(e)
    except UnicodeEncodeError:
        return "lone surrogate"
    except (ValueError, RecursionError):
        return "syntax"
    return None


@F.pandas_udf(StringType())
def strict_json(values: pd.Series) -> pd.Series:
    return values.map(strict_json_problem)


@F.pandas_udf(StringType())
def canonical_sha(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None or strict_json_problem(v) else canonical_json_sha(v))
