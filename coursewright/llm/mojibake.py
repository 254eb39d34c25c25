"""Texts decoded with the wrong character encoding, found and restored.

A garbled text is a node of a graph whose edges are "encode with the codec that
was wrongly used, decode with the right one" and "unescape".  From the text as it
stands a best-first search goes to the cheapest reachable text; states are kept
by hash, so none is visited twice, and double or triple damage is two or three
edges away.  The cost of a text says how implausible its non-ASCII characters are
where they stand: controls and lost characters, capitals or symbols inside words,
scripts mixed in a word, rare letters.

Damage may cover a whole text or places in it, so the search runs over sentences
and lines, then over the words of those that are still implausible.
Plausible text is left alone after one pass.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codecs that texts are wrongly decoded with, and single-byte ones that texts are written in.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "mac_cyrillic", "iso8859-5", "cp1254", "iso8859-15")
RIGHT = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "koi8-r", "cp866", "cp1250", "mac_cyrillic", "iso8859-5")

#: How much cheaper a text must be to be taken for the original: over UTF-8 (a valid sequence by chance is rare) and else.
MARGIN_UTF8, MARGIN_BYTES = 1.2, 3.0
#: Implausibility below which a segment isn't searched.
CALM = 0.9
#: Cost of an escaped character beyond ASCII: more than any character may cost, so that unescaping is always a step down.
ESCAPE_COST = 12.0

_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_ESCAPED = re.compile(r"&(?:amp;)*(#\d{2,7}|#x[0-9a-f]{2,6}|[a-z]{2,8});", re.I)

# Letters of the main European languages beyond ASCII.
_COMMON = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßšž")
_ALONE = frozenset("àéèáê")
_PAIRS = frozenset(("çã", "çõ", "öß", "éé", "íé", "áé", "üß", "äß"))
# Share of each letter in Russian text, in thousandths.
_RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 17, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 0.4), strict=True))
_LETTER_FREE = frozenset("°µ√²³¹™®ªº")


@lru_cache(maxsize=100_000)
def _kind(c: str) -> tuple[str, float]:
    """What a character is, and its cost where it stands well."""
    if c < "\x80":
        return ("u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else " " if c.isspace() else ".", 0.0)
    n, cat = ord(c), unicodedata.category(c)
    if c == "�" or cat in ("Cn", "Co", "Cs") or 0x80 <= n < 0xA0:
        return "x", 6.0
    low = c.lower()
    if low in _COMMON:
        return ("L", 1.0) if c == low else ("U", 1.3)
    if low in _RUSSIAN:
        cost = 0.35 * -math.log(_RUSSIAN[low] / 1000)
        return ("c", cost) if c == low else ("C", cost + 0.2)
    if c in "’‘":
        return "'", 0.8
    if c in "“«¿¡‘":
        return "(", 0.8
    if c in "”»":
        return ")", 0.8
    if c in "–—…":
        return "-", 0.8
    if c in "„‚":
        return "(", 1.2
    if c in "½·×µ§°±≤≥→√∑²³¹¼¾÷←≠≈∞∫∂•†™®©№€£✔":
        return "s", 1.2
    if 0x2500 <= n < 0x25A0:
        return "b", 1.2
    if n == 0xAD or 0x200B <= n <= 0x200F or c in "⁠﻿" or 0xFE00 <= n <= 0xFE0F:
        return "z", 1.0
    if cat == "Zs":
        return " ", 0.6
    if 0x370 <= n < 0x400:
        return "g", 1.5
    if 0x400 <= n < 0x530:
        return ("c", 4.0) if low == c else ("C", 4.2)
    if n < 0x250 and cat[0] == "L":
        return ("L", 2.4) if low == c else ("U", 2.7)
    if 0x3040 <= n < 0x3100 or 0x4E00 <= n < 0xA000 or 0xAC00 <= n < 0xD7A4 or 0x3000 <= n < 0x3030:
        return "o", 1.4
    if 0x1F300 <= n < 0x1FB00 or 0x2600 <= n < 0x27C0:
        return "e", 1.0
    if cat[0] == "M":
        return "m", 2.0
    if cat[0] == "L":
        return "o", 4.5
    return "s", 2.5


_LATIN, _CYRILLIC = frozenset("ulUL"), frozenset("cC")
_LETTERS = frozenset("ulULcCgo")
_LOWER = frozenset("lL")


def _excess(c: str, kind: str, p: str, q: str, before: str, after: str) -> float:
    """What a character costs beyond its own, for the kinds ``p`` and ``q`` of its neighbours."""
    if kind in "LU":
        if p in _CYRILLIC or q in _CYRILLIC:
            return 4.0
        if kind == "U":
            if p in _LOWER:
                return 4.0
            if p == "d":
                return 1.2
            if p in _LATIN and before > "\x7f" and before.lower() + c.lower() not in _PAIRS:
                return 1.0
            return 3.5 if p not in _LETTERS and q not in _LETTERS and q not in "'-m" and c.lower() not in _ALONE else 0.0
        if p in _LATIN and before > "\x7f" and before.lower() + c.lower() not in _PAIRS:
            return 1.0
        if p in " d" and q in " d" and c not in _ALONE:
            return 2.0 if c in "óòïí" else 3.5
        return 1.4 if p not in _LETTERS and q not in _LETTERS and c not in _ALONE and q not in "m'" else 0.0
    if kind in "cC":
        if p in _LATIN or q in _LATIN:
            return 4.0
        if kind == "C":
            return 4.0 if p == "c" else 0.4 if p == "C" else 0.0
        return 2.0 if p not in _LETTERS and q not in _LETTERS and c not in "авиксоуя" else 0.0
    if kind == "s":
        touch = (p in _LETTERS) + (q in _LETTERS)
        if c in _LETTER_FREE:
            return 0.6 if touch and (c in "™®ªº" or (p in _LETTERS and q in _LETTERS)) else 0.0
        return 3.5 if touch else 0.0
    if kind == "b":
        return 4.0 if p in _LETTERS or q in _LETTERS else 1.0 if p in "d." or q in "d." else 0.0
    if kind == "(":
        return 3.5 if p in _LETTERS else 1.0 if c in "¿¡" and q not in _LETTERS else 0.0
    if kind == ")":
        return 3.5 if q in _LETTERS else 0.0
    if kind == "'":
        return 1.5 if p in "dx" else 0.0
    if kind == "-":
        return 1.0 if p in _LETTERS and q in _LETTERS else 0.6 if c != "…" and (p in _LETTERS) != (q in _LETTERS) else 0.0
    if kind == "g":
        return 2.5 if p in _CYRILLIC or q in _CYRILLIC or p in "uUL" or q in "UL" else 0.8 if p in _LATIN or q in _LATIN else 0.0
    if kind == "o":
        return 2.0 if p in _LATIN or q in _LATIN or p in _CYRILLIC or q in _CYRILLIC else 0.0
    if kind == "z":
        return 0.5 if p in "x" else 0.0
    return 0.0


@lru_cache(maxsize=10_000)
def _beyond_ascii(name: str) -> bool:
    """Whether an escape's name or number stands for a character beyond ASCII."""
    return not html.unescape(f"&{name};").isascii()


def implausibility(text: str) -> tuple[float, float]:
    """``cost, excess`` of a text: all its non-ASCII characters cost, and the part that speaks of damage."""
    cost = excess = ESCAPE_COST * sum(m.group().count("amp;") + 1 for m in _ESCAPED.finditer(text) if _beyond_ascii(m[1])) if "&" in text else 0.0
    end = len(text) - 1
    for m in _NON_ASCII.finditer(text):
        i = m.start()
        c = text[i]
        kind, base = _kind(c)
        before, after = text[i - 1] if i else " ", text[i + 1] if i < end else " "
        more = _excess(c, kind, _kind(before)[0], _kind(after)[0], before, after)
        cost += base + more
        excess += more + (base - 1.5 if base > 2.0 and c.lower() not in _RUSSIAN else 0.0)
    return cost, excess


class _Bytes(dict):
    """Character to byte (as a character) of a codec; controls that the codec leaves out stand for themselves, others for no byte."""

    def __missing__(self, key: int) -> str:
        out = chr(key) if key < 0x80 or (0x80 <= key < 0xA0 and chr(key) not in self.values()) else "Ā"
        self[key] = out
        return out


@lru_cache(maxsize=None)
def _to_bytes(codec: str) -> _Bytes:
    table = _Bytes()
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return table


@lru_cache(maxsize=None)
def _recode(wrong: str, right: str) -> dict[int, str]:
    """Character to character: from ``wrong`` back to bytes, and on to ``right``."""
    out = {}
    for point, byte in list(_to_bytes(wrong).items()):
        if "\x80" <= byte <= "\xff":
            try:
                out[point] = bytes([ord(byte)]).decode(right)
            except UnicodeDecodeError:
                continue
    return out


def _from_utf8(text: str, wrong: str) -> str:
    """Every valid UTF-8 sequence among the text's bytes under ``wrong``, decoded; the rest as it is."""
    as_bytes = text.translate(_to_bytes(wrong))
    out, at = [], 0
    for m in _UTF8.finditer(as_bytes):
        out.append(text[at : m.start()])
        out.append(m.group().encode("latin-1").decode("utf-8"))
        at = m.end()
    if not at:
        return text
    out.append(text[at:])
    return "".join(out)


def neighbours(text: str, sequences_only: bool = False) -> Iterator[tuple[str, str, float]]:
    """``text, edge, margin`` of every text one edge away; ``sequences_only``: over UTF-8 and escapes, which are seldom valid by chance."""
    for wrong in WRONG:
        new = _from_utf8(text, wrong)
        if new != text:
            yield new, f"{wrong}>utf-8", MARGIN_UTF8
    if _ESCAPED.search(text):
        yield html.unescape(text), "unescape", MARGIN_UTF8
    for wrong in WRONG if "�" not in text and not sequences_only else ():  # with lost characters only whole sequences can be told
        for right in RIGHT:
            if wrong != right:
                new = text.translate(_recode(wrong, right))
                if new != text:
                    yield new, f"{wrong}>{right}", MARGIN_BYTES


@lru_cache(maxsize=50_000)
def cheapest(text: str) -> tuple[str, tuple[str, ...]]:
    """The cheapest text that can be reached, with the edges that lead to it; the text itself if none is cheaper by the margin.

    The search goes over sequences first; if they leave anything implausible, over all
    edges, and the cheaper of both ends counts.
    """
    state, path = _search(text, True)
    cost, excess = implausibility(state)
    if excess >= CALM:
        other, other_path = _search(text, False)
        if implausibility(other)[0] <= cost:
            return other, other_path
        state, more = _search(state, False)
        path += more
    return state, path


def _search(text: str, sequences_only: bool) -> tuple[str, tuple[str, ...]]:
    """Best-first: the state of least cost is expanded next; an edge that doesn't lower the cost by its margin leads nowhere.

    Each edge lowers the cost, so paths are bounded by the cost of the text itself; the
    search ends where the cheapest queued state is plausible, or with all states seen.
    """
    cost, excess = implausibility(text)
    best = (cost, text, ())
    seen = {hash(text)}
    queue: list[tuple[float, int, str, tuple[str, ...], float]] = [(cost, 0, text, (), excess)]
    n = 0
    while queue:
        cost, _, state, path, excess = heapq.heappop(queue)
        if cost < best[0]:
            best = (cost, state, path)
        if excess < CALM and cost <= best[0]:
            break  # as plausible as can be, and nothing cheaper is queued
        if excess < CALM:
            continue
        for new, edge, margin in neighbours(state, sequences_only):
            if hash(new) in seen:
                continue
            seen.add(hash(new))
            new_cost, new_excess = implausibility(new)
            if new_cost <= cost - margin:
                n += 1
                heapq.heappush(queue, (new_cost, n, new, (*path, edge), new_excess))
    return best[1], best[2]


_LEVELS = (re.compile(r"(?<=\n)|(?<=[.?!:] )"), re.compile(r"(?<=\s)(?=\S)"))


def _repair_at(text: str, level: int, edges: set[str]) -> str:
    out = []
    for part in _LEVELS[level].split(text):
        if (not part.isascii() or "&" in part) and implausibility(part)[1] >= CALM:
            part, path = cheapest(part)
            edges.update(path)
            if level + 1 < len(_LEVELS) and implausibility(part)[1] >= CALM:
                part = _repair_at(part, level + 1, edges)
        out.append(part)
    return "".join(out)


_LOST = re.compile("[\x80-\x84\x86-\x9f�]")


def repair(text: str | None) -> tuple[bool, str | None, list[str]]:
    """``garbled, restored, edges``: whether a text holds wrongly decoded characters, the text with all of them restored that can be, and the edges taken.

    Null and empty texts aren't garbled and stay as they are.  Characters lost for
    good (U+FFFD) and stray controls mark a text as garbled and stay in it.  A text
    that is only escaped comes back unescaped, but nothing in it was wrongly decoded,
    so it isn't garbled; escapes of ASCII characters (``&lt;``) are left alone.
    """
    if not text or (text.isascii() and "&" not in text):  # neither a character nor an escape beyond ASCII
        return False, text, []
    edges: set[str] = set()
    fixed = _repair_at(text, 0, edges)
    return bool(edges - {"unescape"} or _LOST.search(text)), fixed, sorted(edges)


def repair_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, garbled, restored, edges`` per row of ``df``; further columns are left out."""
    schema = T.StructType([df.schema[id_col], T.StructField("garbled", T.BooleanType(), False), T.StructField("restored", T.StringType()), T.StructField("edges", T.ArrayType(T.StringType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [repair(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def garbled_only(repaired: DataFrame) -> DataFrame:
    return repaired.filter(F.col("garbled"))
