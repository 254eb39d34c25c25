"""Noise in the text of scanned pages: found line by line, and repaired into paragraphs.

Words are grouped by a *skeleton* in which glyphs that scanners confuse are one;
within a group the form that most papers (or the word's own paper) write is the
right one.  Invented names and identifiers are too rare for that: there the
groups of three letters at the place in doubt are compared, as they stand in the
words of all papers.  Running titles are lines at the head or foot whose skeleton
returns on a paper's pages, with digits masked where papers are compared; page
numbers are told by their style and by running along with the pages.  A hyphen at
a line's end is a cut if the word is written without it elsewhere.

Pages are parsed one by one (their lines are bounded); everything that crosses
pages is aggregates and joins on keys of paper and word, with one row per page
where an order of pages is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.session import apart, cut, sized

# What a glyph or pair of glyphs is misread as (from, to).
CONFUSIONS = (
    ("c", "e"), ("(", "c"), ("(", "e"), ("f", "t"), ("o", "a"), ("5", "s"), ("!", "i"), ("0", "o"), ("l", "i"), ("1", "l"), ("b", "h"), ("cl", "d"), ("ii", "u"), ("6", "b"), ("9", "g"),
    ("y", "v"), ("ri", "n"), ("rn", "m"), ("vv", "w"), ("m", "in"), ("m", "rn"), ("8", "b"), ("1", "i"), ("0", "a"), ("|", "l"), ("t", "f"), ("e", "c"), ("i", "l"), ("h", "b"), ("h", "li"), ("d", "cl"), ("v", "y"), ("a", "o"),
)
# the pairs as they look once single glyphs are folded
_PAIR = re.compile("rn|rl|cl|vv|ll|ln")
_PAIRS = {"rn": "m", "rl": "n", "cl": "d", "vv": "w", "ll": "u", "ln": "m"}
_GLYPHS = str.maketrans({"e": "c", "(": "c", "f": "t", "a": "o", "0": "o", "5": "s", "i": "l", "1": "l", "!": "l", "|": "l", "h": "u", "b": "u", "6": "u", "8": "u", "9": "g", "q": "g", "y": "v"})

#: Lines from the top or the bottom of a page (blank ones aside) where titles and numbers stand.
ZONE = 3
#: How many times more papers must write the right form.
FORM_RATIO, FORM_LEAST = 8, 5
#: The same for groups of three letters, and for a paper's own identifiers.
GRAM_RATIO, GRAM_LEAST, NAME_RATIO = 12.0, 12, 60.0
#: Forms in fewer papers than this, or than this share of all papers, may be doubted for their letters; the same within one paper.
RARE, RARE_SHARE, LOCAL, LOCAL_SHARE = 40, 1 / 30, 4, 1 / 300
#: Confusions by which one form may come from another.
MOST_CONFUSED = 2
#: Shares from which on a form is a word of its own: of its places with strange neighbours, and among these of neighbours it has in several papers.
STRANGE, OWN = 0.5, 1 / 3
#: Rows up to which a column of 64-bit keys is broadcast.
NARROW = 500_000
MARKS = "-‐\xad¬"

_NUM = r"[0-9lIoOSsBbgz!|]{1,4}"
_STYLES = (
    ("page of", re.compile(rf"^p[ao0]g[ec]\s*({_NUM})\s*[oa][ft]\s*{_NUM}$", re.I)),
    ("page no", re.compile(rf"^p[ao0]g[ec]\s*n[oa0]\.?\s*({_NUM})$", re.I)),
    ("page", re.compile(rf"^p[ao0]g[ec]\s*({_NUM})$", re.I)),
    ("pg", re.compile(rf"^p[g9]\.?\s*({_NUM})$", re.I)),
    ("pto", re.compile(rf"^p\.?\s*[tf]\.?\s*[o0]\.?\s+({_NUM})$", re.I)),
    ("dash", re.compile(rf"^[-–—~]\s*({_NUM})\s*[-–—~]$")),
    ("box", re.compile(rf"^[\[(]\s*({_NUM})\s*[\])]$")),
    ("slash", re.compile(rf"^({_NUM})\s*/\s*{_NUM}$")),
    ("bare", re.compile(rf"^({_NUM})$")),
)
_ROMAN = re.compile(r"^[ivxlu1!y]{1,6}$", re.I)
_DIGITS = str.maketrans({"l": "1", "I": "1", "!": "1", "|": "1", "o": "0", "O": "0", "S": "5", "s": "5", "B": "8", "b": "6", "g": "9", "z": "2"})
_GAP = re.compile(r"^(.*\S)\s{3,}(\S.*)$")
_CODE = re.compile(r"[{};]\s*$|^\s*(?:int|for|while|if|return|emit)\b.*[({;]|^```")
_EDGE = "\"'`.,;:?[]{}*<>=+/%&~“”‘’·$"
_SPLIT = re.compile(r"[\[\]{};,=<>+*/%&\"“”:?$·]+")
_CALL = re.compile(r"(?<=[0-9_])\(|\(\)|\)\(|\)")


@lru_cache(maxsize=400_000)
def skeleton(word: str) -> str:
    """``word`` with confusable glyphs made one; whitespace is left out."""
    w = "".join(word.lower().split()).translate(_GLYPHS)
    while True:
        folded = _PAIR.sub(lambda m: _PAIRS[m.group()], w)
        if folded == w:
            return folded
        w = folded


def form_of(word: str) -> str:
    """A word without what a sentence's start or a heading does to its case; other capitals stay."""
    return word.lower() if word[1:].islower() or word.isupper() or len(word) == 1 or not any(c.isupper() for c in word[1:]) else word


@lru_cache(maxsize=400_000)
def _words_in(token: str) -> tuple[str, ...]:
    """The words and numbers of a text without blanks; a bracket that stands in a letter's place stays in its word."""
    out = []
    for piece in _SPLIT.split(token):
        piece = piece.strip(_EDGE)
        if "(" in piece and not re.search(r"[A-Za-z]\([a-z]", piece) or ")" in piece:
            parts = re.split(r"[()]+", piece)
        elif re.search(r"[0-9]\(", piece):
            parts = re.split(r"[()]+", piece)
        else:
            parts = [piece.strip("()")]
        out += [p for p in (x.strip(_EDGE + "-") for x in parts) if p and any(c.isalnum() for c in p)]
    return tuple(out)


def words_of(line: str) -> list[str]:
    """The words and numbers of a line."""
    return [w for token in line.split() for w in _words_in(token)]


def roman_value(text: str) -> int | None:
    t = text.lower().replace("u", "ii").translate(str.maketrans({"l": "i", "1": "i", "!": "i", "y": "v"}))
    if not re.fullmatch(r"x{0,3}(?:ix|iv|v?i{0,3})", t) or not t:
        return None
    values = [{"i": 1, "v": 5, "x": 10}[c] for c in t]
    return sum(-v if any(v < n for n in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def number_style(text: str) -> tuple[str, int] | None:
    """``style, value`` if a text is nothing but a printed page number, misread or not."""
    t = text.strip()
    if len(t) > 24:
        return None
    for style, pattern in _STYLES:
        if m := pattern.match(t):
            digits = m.group(1).translate(_DIGITS)
            if digits.isdigit() and (style != "bare" or any(c.isdigit() for c in m.group(1)) or len(t) == 1):
                return style, int(digits)
    if _ROMAN.match(t) and (v := roman_value(t)):
        return "roman", v
    return None


def shape_of(title: str) -> str:
    """A title with its digits masked and the words that vary from paper to paper left open."""
    parts = []
    for t in title.split():
        bare = t.strip("·/-")
        if not bare:
            parts.append(t)
        elif any(c.isdigit() for c in bare) and not re.search(r"[a-z]{2}", bare):
            parts.append("#")
        elif re.fullmatch(r"[A-Z0-9]{3}", bare):
            parts.append("@")
        else:
            parts.append(skeleton(re.sub(r"[0-9]{2,}", "#", bare)))
    return " ".join(parts)


def read_pages(pages: DataFrame) -> DataFrame:
    """``page_id, paper, page_no, text`` of each page once.

    A page sent twice counts once (rows of one ``page_id`` are one page, the
    latest counts); pages with a null id or text are left out, a null ``paper`` is a
    paper of its own.  The page's place is its ``page_num``, where that is null the
    number at the end of its id.
    """
    one = pages.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max(F.struct("extracted_at", "text", "paper", "page_num")).alias("m"))
    place = F.coalesce(F.col("m.page_num").cast("int"), F.nullif(F.regexp_extract("page_id", r"([0-9]{1,8})[^0-9]*$", 1), F.lit("")).cast("int"))
    return one.select("page_id", F.coalesce("m.paper", F.concat(F.lit("?"), "page_id")).alias("paper"), place.alias("page_no"), "m.text").filter("text is not null")


EDGE_LINE = T.StructType([T.StructField(n, t) for n, t in (("paper", T.StringType()), ("page_id", T.StringType()), ("page_no", T.IntegerType()), ("line_no", T.IntegerType()), ("edge", T.IntegerType()), ("title", T.StringType()), ("shape", T.StringType()), ("style", T.StringType()), ("value", T.IntegerType()))])


def _edge_lines(text: str) -> Iterator[tuple]:
    """``line_no, edge, title, shape, style, value`` of the lines at a page's head and foot that may be a title or number."""
    lines = text.split("\n")
    solid = [i for i, x in enumerate(lines) if x.strip()]
    for rank in sorted({*range(min(ZONE, len(solid))), *range(max(0, len(solid) - ZONE), len(solid))}):
        whole = lines[solid[rank]].strip()
        title = shape = style = value = None
        if found := number_style(whole):
            style, value = found
        else:
            gap = _GAP.match(whole)
            if gap and (found := number_style(gap.group(2))):
                whole, (style, value) = gap.group(1), found
            if sum(c.isalnum() for c in whole) >= 8 and any(c.isdigit() for c in whole) and not _CODE.search(whole):
                title, shape = skeleton(whole), shape_of(whole)
        if title or style:
            yield solid[rank] + 1, min(rank, len(solid) - 1 - rank), title, shape, style, value


def edge_lines(read: DataFrame) -> DataFrame:
    """The lines of ``EDGE_LINE`` of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *line) for i, t in enumerate(batch.column("text").to_pylist()) for line in _edge_lines(t)]
            take = pa.array([r[0] for r in rows], pa.int32())
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(take) for n in ("paper", "page_id", "page_no")], *[pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]], names=EDGE_LINE.names)

    return read.select("page_id", "paper", "page_no", "text").mapInArrow(run, EDGE_LINE)


# ---- running titles and page numbers


def running_lines(lines: DataFrame) -> DataFrame:
    """``page_id, line_no`` of running titles: their skeleton returns on pages of the paper, or their shape is that of many papers' running titles."""
    zone = lines.filter("title is not null")
    per_paper = zone.groupBy("paper", "title").agg(F.count_distinct("page_id").alias("pages"), F.first("shape").alias("shape"))
    returning = per_paper.filter("pages > 1")
    common = returning.groupBy("shape").agg(F.count(F.lit(1)).alias("papers")).filter("papers > 1").select("shape")
    by_return = zone.join(apart(returning.select("paper", "title")), ["paper", "title"], "left_semi")
    by_shape = zone.filter("edge < 2").join(sized(common), "shape", "left_semi")
    return by_return.select("page_id", "line_no").union(by_shape.select("page_id", "line_no")).distinct()


def number_lines(lines: DataFrame) -> DataFrame:
    """``page_id, line_no`` of printed page numbers.

    Styles that say what they are count as they stand.  Bare and Roman numbers
    count where they run along with the pages: their distance from the page's
    place is the one most pages of the paper have in that style, on two pages or
    more, or it is none.
    """
    found = lines.filter("style is not null")
    plain = found.filter("style in ('bare', 'roman', 'slash')").withColumn("off", F.col("value") - F.col("page_no"))
    counts = plain.groupBy("paper", "style", "off").agg(F.count_distinct("page_id").alias("n"))
    best = counts.groupBy("paper", "style").agg(F.max(F.struct("n", -F.abs("off"), "off")).alias("m")).select("paper", "style", F.col("m.off").alias("off"), F.col("m.n").alias("n"))
    alone = plain.join(apart(best), ["paper", "style", "off"]).filter("n > 1 or off = 0 or (value between 1 and 12 and edge = 0)")
    told = found.filter("style not in ('bare', 'roman', 'slash')")
    return told.select("page_id", "line_no").union(alone.select("page_id", "line_no")).distinct()


# ---- words


_NUMBER_MISREAD = re.compile(r"^(?=.*[0-9])[0-9lSsBOo!|I]+$")
_LONE = frozenset("lSBOo")
_ODD = re.compile(r"[A-Za-z][!|][A-Za-z]|^[!|][a-z]{2}|[A-Za-z][0-9!]+[a-z]{2}|[a-z][0-9][a-z]|^[0569][a-z]{2,}|[a-z]{2}[!|]$")


def odd_by_itself(word: str, code: bool) -> bool:
    """Whether a word's own glyphs give it away: letters in a number, a sign or figure among letters."""
    if word.isdigit():
        return False
    if _NUMBER_MISREAD.match(word):
        return True
    if len(word) == 1:
        return word in _LONE and not code
    return bool(_ODD.search(word)) and not re.search(r"\d{2,}[a-z]", word)


@lru_cache(maxsize=400_000)
def _pieces(word: str, whole: bool, code: bool) -> tuple[tuple[str, str, bool], ...]:
    """``form, skeleton, odd`` of a word's parts between hyphens; a cut word is one part. Numbers are left out."""
    if word.isdigit():
        return ()
    return tuple((form_of(p), skeleton(form_of(p)), odd_by_itself(p, code)) for p in ([word] if whole else re.split(r"[-‐]", word)) if p and not p.isdigit())


def _mark(line: str) -> str | None:
    """The hyphen at a line's end, if it follows a letter."""
    end = line.rstrip()
    return end[-1] if len(end) > 1 and end[-1] in MARKS and end[-2].isalpha() else None


def _body(text: str, frame: list[int] | None) -> list[tuple[int, str]]:
    """``line_no, line`` of a page's solid lines that are no titles or numbers."""
    out = set(frame or ())
    return [(i, x) for i, x in enumerate(text.split("\n"), 1) if x.strip() and i not in out]


def page_ends(framed: DataFrame) -> DataFrame:
    """Per page with words what its neighbours end and start with: ``page_id, page_next, page_prev, page_mark, page_at``.

    Pages are ordered within their paper with one small row per page.
    """
    schema = "paper string, page_id string, page_no int, first_word string, end_word string, end_mark string, end_line int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (text, frame) in enumerate(zip(batch.column("text").to_pylist(), batch.column("frame").to_pylist(), strict=True)):
                body = _body(text, frame)
                first = next((w for _, x in body if (w := words_of(x))), None)
                if first:
                    no, line, last = next((n, x, w) for n, x in reversed(body) if (w := words_of(x)))
                    rows.append((i, first[0], last[-1], _mark(line), no))
            take = pa.array([r[0] for r in rows], pa.int32())
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(take) for n in ("paper", "page_id", "page_no")], *[pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]], names=["paper", "page_id", "page_no", "first_word", "end_word", "end_mark", "end_line"])

    ends = framed.select("page_id", "paper", "page_no", "text", "frame").mapInArrow(run, schema)
    pages = Window.partitionBy("paper").orderBy("page_no", "page_id")
    at = F.struct("page_id", F.col("end_line").alias("line_no"))
    return ends.select("page_id", F.lead("first_word").over(pages).alias("page_next"), F.lag("end_word").over(pages).alias("page_prev"), F.lag("end_mark").over(pages).alias("page_mark"), F.lag(at).over(pages).alias("page_at"))


BODY = T.StructType(
    [T.StructField("paper", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("page_no", T.IntegerType()), T.StructField("line_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("code", T.BooleanType()),
     T.StructField("forms", T.ArrayType(T.StringType())), T.StructField("odd", T.BooleanType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType()),
     T.StructField("tail", T.StringType()), T.StructField("tail_split", T.IntegerType()), T.StructField("head", T.StringType()), T.StructField("head_split", T.IntegerType()),
     T.StructField("cut_joined", T.StringType()), T.StructField("cut_compound", T.StringType()), T.StructField("compounds", T.ArrayType(T.StringType())), T.StructField("prev_page", T.StringType()), T.StructField("prev_line", T.IntegerType())]
)


def _line_words(words: list[str], mark: str | None, after: str | None, prev_mark: str | None, prev_last: str | None, code: bool) -> tuple:
    """The columns ``forms`` to ``compounds`` of a line with words.

    ``forms`` has the words that stand whole in the line, ``tail`` and ``head`` the
    joined word of which the line holds the first or second half, with the length of
    the first half.
    """
    forms, odd = [], False
    tail = tail_split = head = head_split = joined = compound = None
    n = len(words)
    for i, w in enumerate(words):
        if mark and i == n - 1 and after:
            bare = w.strip(MARKS)
            if found := _pieces(bare + after, True, code):
                tail, tail_split = found[0][0], len(bare)
            a = w.rstrip(MARKS)
            if a[-1:].isascii() and a[-1:].isalpha() and re.match(r"[A-Za-z0-9(!_]", after):
                joined, compound = skeleton(a + after), f"{skeleton(a)}-{skeleton(after)}"
        elif prev_mark and i == 0 and prev_last:
            bare = prev_last.strip(MARKS)
            if found := _pieces(bare + w, True, code):
                head, head_split = found[0][0], len(bare)
        else:
            for f, _, strange in _pieces(w, False, code):
                forms.append(f)
                odd = odd or strange
    compounds = [f"{skeleton(p[0])}-{skeleton(p[1])}" for w in words if len(p := re.split(r"[-‐]", w)) == 2 and re.search(r"[A-Za-z]{2}[-‐][A-Za-z]{2}", w)]
    return forms, odd, form_of(prev_last) if prev_last else None, form_of(after) if after else None, tail, tail_split, head, head_split, joined, compound, compounds


def body_lines(framed: DataFrame) -> DataFrame:
    """The solid lines of the papers' own text with their words, cut words joined, as ``BODY``. ``framed``: pages with ``frame`` and their neighbours' ends."""
    kinds = [pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.bool_(), *[pa.string()] * 3, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32()]

    def batch_of(batch: pa.RecordBatch, take: list[int], rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array(take, pa.int32())
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([*[batch.column(n).take(at) for n in ("paper", "page_id", "page_no")], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=BODY.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = ([], False, *[None] * 8, [])
        for batch in batches:
            take, rows = [], []
            fields = [batch.column(n).to_pylist() for n in ("page_id", "text", "frame", "page_next", "page_prev", "page_mark", "page_at")]
            for at, (page_id, text, frame, page_next, last, mark, place) in enumerate(zip(*fields, strict=True)):
                lines = [(no, x, words_of(x)) for no, x in _body(text, frame)]
                firsts = [w[0] for _, _, w in lines if w][1:] + [page_next]  # the word that follows each line with words
                prev = (place["page_id"], place["line_no"]) if place else (None, None)
                k = 0
                for no, x, words in lines:
                    take.append(at)
                    code = bool(_CODE.search(x))
                    if not words:
                        rows.append((no, x, code, *none, None, None))
                        continue
                    own = _mark(x)
                    rows.append((no, x, code, *_line_words(words, own, firsts[k], mark, last, code), *prev))
                    mark, last, prev = own, words[-1], (page_id, no)
                    k += 1
                if len(rows) > 20_000:
                    yield batch_of(batch, take, rows)
                    take, rows = [], []
            yield batch_of(batch, take, rows)

    return framed.select("page_id", "paper", "page_no", "text", "frame", "page_next", "page_prev", "page_mark", "page_at").mapInArrow(run, BODY)


def line_words(body: DataFrame) -> DataFrame:
    """``paper, page_id, line_no, form, half, split, left, next``: the words that may be misread, cut ones once for each half's line."""
    n = F.size("forms")
    whole = F.transform("forms", lambda f, i: F.struct(f.alias("form"), F.lit(0).alias("half"), F.lit(0).alias("split"), F.when(i > 0, F.get("forms", i - 1)).otherwise(F.col("before")).alias("left"), F.when(i < n - 1, F.get("forms", i + 1)).otherwise(F.col("after")).alias("next")))
    part = lambda name, half: F.array(F.struct(F.col(name).alias("form"), F.lit(half).alias("half"), F.col(f"{name}_split").alias("split"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("next")))
    return body.select("paper", "page_id", "line_no", F.inline(F.concat(whole, part("tail", 1), part("head", 2)))).filter("form is not null")


def _core(form: str) -> str:
    return re.sub(r"[0-9]+$", "", form.lower())


def _grams(core: str) -> list[str]:
    padded = f"^{core}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def better_reading(form: str, grams: dict[str, int]) -> tuple[str, int] | None:
    """The form with one confusion undone whose letters are far better supported at that place, and the place; none if there is no such."""
    core = _core(form)
    if len(core) < 4:
        return None
    padded = f"^{core}$"
    ratio = GRAM_RATIO if core == form.lower() else NAME_RATIO  # identifiers join their parts more freely
    best = None
    for noise, true in CONFUSIONS:
        at = padded.find(noise, 1)
        while at > 0:
            new = padded[:at] + true + padded[at + len(noise) :]
            lo = max(0, at - 2)
            old_least = min(grams.get(padded[i : i + 3], 0) for i in range(lo, min(at + len(noise), len(padded) - 2)))
            new_least = min(grams.get(new[i : i + 3], 0) for i in range(lo, min(at + len(true), len(new) - 2)))
            if new_least >= GRAM_LEAST and new_least >= ratio * max(old_least, 1) and (best is None or new_least > best[0]):
                best = (new_least, new[1:-1] + form[len(core) :], at - 1)
            at = padded.find(noise, at + 1)
    return (best[1], best[2]) if best else None


def confusions_between(form: str, right: str) -> int:
    """The least number of confusions that make ``form`` of ``right``; a large number if none do."""
    far = 99
    form, right = form.lower(), right.lower()
    cost = [[far] * (len(right) + 1) for _ in range(len(form) + 1)]
    cost[0][0] = 0
    for i in range(len(form) + 1):
        for j in range(len(right) + 1):
            c = cost[i][j]
            if c >= far:
                continue
            if i < len(form) and j < len(right) and form[i] == right[j]:
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], c)
            for noise, true in CONFUSIONS:
                if form.startswith(noise, i) and right.startswith(true, j):
                    cost[i + len(noise)][j + len(true)] = min(cost[i + len(noise)][j + len(true)], c + 1)
    return cost[-1][-1]


def _confusable(forms: DataFrame) -> DataFrame:
    """The rows (``form, right``, ...) whose form may be a misread ``right``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("form").to_pylist(), batch.column("right").to_pylist()
            yield batch.filter(pa.array([x != y and (x.lower() == y.lower() or confusions_between(x, y) <= MOST_CONFUSED) for x, y in zip(a, b, strict=True)], pa.bool_()))

    return forms.mapInArrow(run, forms.schema)


def paper_forms(words: DataFrame) -> DataFrame:
    """``paper, form, n, alone, joined``: how often a paper writes a form, how often of it uncut, and whether it does so at cuts."""
    return words.groupBy("paper", "form").agg(F.sum((F.col("half") < 2).cast("int")).alias("n"), F.sum((F.col("half") == 0).cast("int")).alias("alone"), F.max((F.col("half") > 0).cast("int")).alias("joined"))


def all_forms(by_paper: DataFrame) -> DataFrame:
    """``form, papers, most, joined, skel``: each form with the papers that write it."""
    forms = by_paper.groupBy("form").agg(F.count(F.lit(1)).alias("papers"), F.max("n").alias("most"), F.min("joined").alias("joined"))
    schema = T.StructType([*forms.schema.fields, T.StructField("skel", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([skeleton(f) for f in batch.column(0).to_pylist()], pa.string())], names=schema.names)

    return forms.mapInArrow(run, schema)


def in_context(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``form, right, paper, page_id, line_no, seen, own`` for each place of the forms of ``pairs`` (``form, right``).

    ``seen``: the word before or after it stands beside the right form elsewhere, as it
    does where the form is a misreading; ``own``: it stands beside the form in
    another paper, as it does where the form is a word of its own.
    """
    columns = ["form", "right", "paper", "page_id", "line_no"]
    whole = words.filter("half = 0")
    beside = lambda word, side: F.when(F.col(side).isNotNull(), F.xxhash64(word, F.lit(side), side))
    asked = [F.struct(F.lit(what).alias("what"), beside(word, side).alias("key")) for what, word in (("seen", "right"), ("own", "form")) for side in ("left", "next")]
    places = cut(whole.join(sized(pairs), "form").select(*columns, F.posexplode(F.array(*asked)).alias("i", "a")).select(*columns, "a.what", "a.key"))
    # only the neighbourhoods that are asked for are counted, not those of all frequent words
    keys = places.select("key").filter("key is not null").distinct()
    found = whole.select("paper", F.explode(F.array(beside("form", "left"), beside("form", "next"))).alias("key")).join(sized(keys, NARROW), "key")
    mark = F.xxhash64("paper")
    known = found.groupBy("key").agg((F.min(mark) != F.max(mark)).alias("several"))
    told = places.join(apart(cut(known)), "key", "left")
    yes = lambda what, c: F.max((F.col("what") == what) & F.coalesce(c, F.lit(False))).alias(what)
    return told.groupBy(*columns).agg(yes("seen", F.col("several").isNotNull()), yes("own", F.col("several")))


def misread_forms(words: DataFrame, by_paper: DataFrame | None = None, forms: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``form, right`` that are misread wherever they stand, ``paper, form, right`` that are so in one paper, and ``page_id, line_no, form, right`` that are so at that place.

    A form of letters alone that several papers write may be a word of its own
    ("bear" beside "hear").  It is, if at half of its places or more neither
    neighbour is one of the right form's, and a third of these places have a neighbour
    that it has in other papers too; such a form counts as misread only at the places
    whose neighbours are the right form's and not its own.
    """
    by_paper = cut(paper_forms(words)) if by_paper is None else by_paper
    n_papers = by_paper.agg(F.count_distinct("paper")).first()[0]
    rare_at, local_at = max(RARE, n_papers * RARE_SHARE), max(LOCAL, n_papers * LOCAL_SHARE)
    forms = cut(all_forms(by_paper)) if forms is None else forms
    leading = forms.groupBy("skel").agg(F.max(F.struct("papers", "form")).alias("m")).select("skel", F.col("m.form").alias("right"), F.col("m.papers").alias("right_papers"))
    by_form = forms.join(apart(leading), "skel").filter(F.col("form") != F.col("right"))
    # a form whose own glyphs give it away is no word, however few papers write the right one
    told = F.col("form").rlike(_ODD.pattern) & ~F.col("form").rlike(r"\d{2,}[a-z]") & F.col("right").rlike("^[A-Za-z]+$")
    by_form = by_form.filter(told | (F.col("right_papers") >= F.greatest(F.lit(FORM_LEAST), FORM_RATIO * F.col("papers")))).select("form", "right", "papers")
    by_form = cut(_confusable(by_form))
    doubtful = by_form.filter((F.col("papers") > 1) & F.col("form").rlike("^[A-Za-z]+$")).select("form", "right")
    places = cut(in_context(words, doubtful))
    own = cut(places.groupBy("form", "right").agg(F.avg(F.col("seen").cast("int")).alias("share"), F.avg(F.when(~F.col("seen"), F.col("own").cast("int"))).alias("own_share"), F.count_distinct(F.when(~F.col("seen"), F.col("paper"))).alias("strange")).filter(f"share <= {1 - STRANGE} and strange > 1 and own_share >= {OWN}").select("form", "right"))
    placed = places.join(apart(own.select("form")), "form", "left_semi").filter("seen and not own").select("page_id", "line_no", "form", "right")
    by_form = by_form.select("form", "right").join(apart(own.select("form")), "form", "left_anti")
    # letters in threes over the different words of all papers; their number is bounded by the alphabet
    core = F.regexp_replace(F.lower("form"), "[0-9]+$", "")
    types = forms.select(F.concat(F.lit("^"), core, F.lit("$")).alias("w"), "papers").filter(r"w rlike '^\\^[a-z_]{3,40}\\$$'").groupBy("w").agg(F.sum("papers").alias("papers"))
    grams = types.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, 3))).alias("g"), "papers").groupBy("g").agg(F.sum("papers").alias("n"))
    table = {r.g: r.n for r in grams.collect()}  # at most 28 ** 3 rows
    settled = by_form.select("form").union(own.select("form"))
    # a name that its paper writes twice and no other way isn't doubted for its letters
    rare = forms.filter((F.col("papers") < rare_at) & ((F.col("most") < 2) | ~F.col("form").rlike("[0-9]$"))).join(apart(settled), "form", "left_anti").select("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, b[0]) for f in batch.column(0).to_pylist() if (b := better_reading(f, table))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.string())], names=["form", "right"])

    by_grams = rare.mapInArrow(run, "form string, right string")
    everywhere = cut(by_form.unionByName(by_grams))
    # in one paper: the form that is written more often there, both being rare elsewhere
    few = forms.filter((F.col("papers") < local_at) & F.col("form").rlike("[a-z_]{3}")).select("form", "skel").join(sized(everywhere.select("form")), "form", "left_anti")
    few = cut(few.join(apart(few.groupBy("skel").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("skel")), "skel"))  # others have no rival
    local = cut(by_paper.select("paper", "form", "n").join(sized(few.select("form", "skel")), "form"))
    top = local.groupBy("paper", "skel").agg(F.max(F.struct("n", "form")).alias("m")).select("paper", "skel", F.col("m.form").alias("right"), F.col("m.n").alias("right_n"))
    in_paper = local.join(apart(top), ["paper", "skel"]).filter((F.col("form") != F.col("right")) & (F.col("right_n") > F.col("n"))).select("paper", "form", "right")
    return everywhere, cut(_confusable(in_paper)), placed


def cut_words(body: DataFrame, by_paper: DataFrame, forms: DataFrame) -> DataFrame:
    """``page_id, line_no`` of the lines that end in the first part of a cut word.

    The joined word against the compound: what more papers write decides; with
    neither written elsewhere the word counts as cut.
    """
    ends = body.filter("cut_joined is not null").select("page_id", "line_no", F.col("cut_joined").alias("joined"), F.col("cut_compound").alias("compound"))
    compounds = body.filter("size(compounds) > 0").select("paper", F.explode("compounds").alias("compound")).groupBy("compound").agg(F.count_distinct("paper").alias("as_compound"))
    asked = forms.join(sized(ends.select(F.col("joined").alias("skel")).distinct()), "skel", "left_semi").select("form", F.col("skel").alias("joined"))
    whole = by_paper.filter("alone > 0").select("form", "paper").join(sized(cut(asked)), "form").groupBy("joined").agg(F.count_distinct("paper").alias("as_word"))
    rated = ends.join(apart(compounds), "compound", "left").join(apart(whole), "joined", "left")
    return rated.filter(F.coalesce("as_word", F.lit(0)) >= F.coalesce("as_compound", F.lit(0))).select("page_id", "line_no")


def _analyse(pages: DataFrame) -> dict[str, DataFrame]:
    read = cut(read_pages(pages))
    edges = cut(edge_lines(read))
    frame = cut(running_lines(edges).withColumn("kind", F.lit("running")).unionByName(number_lines(edges).withColumn("kind", F.lit("pageno"))))
    per_page = frame.groupBy("page_id").agg(F.collect_set("line_no").alias("frame"))  # a few lines at a page's edges
    framed = cut(read.join(apart(per_page), "page_id", "left"))
    body = cut(body_lines(framed.join(apart(page_ends(framed)), "page_id", "left")))
    words = line_words(body)
    by_paper = cut(paper_forms(words))
    forms = cut(all_forms(by_paper))
    everywhere, in_paper, placed = misread_forms(words, by_paper, forms)
    columns = ["page_id", "line_no", "form", "right", "half", "split"]
    hit = words.join(sized(everywhere), "form").select(*columns).unionByName(words.join(sized(in_paper), ["paper", "form"]).select(*columns))
    hit = hit.unionByName(placed.withColumn("half", F.lit(0)).withColumn("split", F.lit(0)).select(*columns))
    return {"frame": frame, "body": body, "cuts": cut_words(body, by_paper, forms), "hits": hit}


def line_kinds(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, kind`` of all noisy lines; see TESTDATA for the kinds. An empty table gives no rows."""
    found = _analyse(pages)
    # of a cut word the line that holds the differing glyph is the misread one
    differs = F.aggregate(F.sequence(F.lit(1), F.length("form")), F.lit(0), lambda acc, i: F.when((acc == 0) & (F.substring("form", i, F.lit(1)) != F.substring("right", i, F.lit(1))), i).otherwise(acc))
    hit = found["hits"].filter((F.col("half") == 0) | ((differs <= F.col("split")) == (F.col("half") == 1)))
    odd = found["body"].filter("odd").select("page_id", "line_no")
    misread = hit.select("page_id", "line_no").union(odd).distinct()
    return found["frame"].unionByName(found["cuts"].withColumn("kind", F.lit("hyphen"))).unionByName(misread.withColumn("kind", F.lit("misread"))).select("page_id", "line_no", "kind")


def restore_line(text: str, fixes: list[tuple[str, str]]) -> str:
    """A line with its misread words written right, runs of blanks narrowed, and letters in its numbers turned to figures."""
    for form, right in fixes:
        pattern = re.compile(rf"(?<![A-Za-z0-9_]){re.escape(form)}(?![A-Za-z0-9_])", re.I)
        text = pattern.sub(lambda m, r=right: r[:1].upper() + r[1:] if m.group()[:1].isupper() else r, text)
    text = re.sub(r"(?<=\S)[ \t]{2,}", " ", text)
    return re.sub(r"(?<![\w!|])(?=[lSsBOo!|I]*[0-9])[0-9lSsBOo!|I]{2,}(?![\w!|])", lambda m: m.group() if m.group().isdigit() else m.group().translate(_DIGITS), text)


def restore_half(text: str, form: str, right: str, half: int, split: int) -> str:
    """A line with its part of a cut word written right: what stands before the mark at its end (half 1), or its first letters (half 2)."""
    old, new = (form[:split], right[:split]) if half == 1 else (form[split:], right[split:])
    pattern = rf"{re.escape(old)}(?=[{MARKS}]\s*$)" if half == 1 else rf"(?<![A-Za-z0-9_]){re.escape(old)}(?![A-Za-z0-9_])"
    return re.sub(pattern, lambda m: new[:1].upper() + new[1:] if half == 1 and m.group()[:1].isupper() else new, text, count=1, flags=re.I)


def paragraphs(pages: DataFrame) -> DataFrame:
    """``paper, paragraph, text, first_page, n_lines``: each paper as continuous paragraphs.

    Running titles and page numbers are gone, cut words joined, misread words
    written right.  A paragraph starts at a question's number, after a blank line
    that follows a sentence's end, and around code, whose lines keep their breaks.
    Lines are put together per page; only one row per page is ordered across
    pages, so a paper of very many pages is no single large task.
    """
    found = _analyse(pages)
    found |= {"cuts": cut(found["cuts"]), "hits": cut(found["hits"])}
    fixes = found["hits"].filter("half = 0").groupBy("page_id", "line_no").agg(F.collect_set(F.struct("form", "right")).alias("fixes"))
    # both lines of a cut word are written right, if it is joined
    joined = found["cuts"].join(apart(found["body"].filter("prev_page is not null").select(F.col("prev_page").alias("page_id"), F.col("prev_line").alias("line_no"), F.col("page_id").alias("to_page"), F.col("line_no").alias("to_line"))), ["page_id", "line_no"])
    lines = joined.select("page_id", "line_no", F.lit(1).alias("half")).unionByName(joined.select(F.col("to_page").alias("page_id"), F.col("to_line").alias("line_no"), F.lit(2).alias("half")))
    halves = found["hits"].join(apart(lines), ["page_id", "line_no", "half"], "left_semi").groupBy("page_id", "line_no").agg(F.collect_set(F.struct("form", "right", "half", "split")).alias("halves"))
    body = found["body"].select("paper", "page_id", "page_no", "line_no", "text", "code").join(apart(fixes), ["page_id", "line_no"], "left").join(apart(halves), ["page_id", "line_no"], "left").join(apart(found["cuts"].withColumn("cut", F.lit(True))), ["page_id", "line_no"], "left")
    schema = T.StructType([body.schema[c] for c in ("paper", "page_id", "page_no", "line_no", "code", "cut")] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [batch.column(n) for n in schema.names[:-1]]
            texts = []
            for t, fx, hs in zip(batch.column("text").to_pylist(), batch.column("fixes").to_pylist(), batch.column("halves").to_pylist(), strict=True):
                for h in hs or []:
                    t = restore_half(t, h["form"], h["right"], h["half"], h["split"])
                texts.append(restore_line(t, [(f["form"], f["right"]) for f in fx or []]))
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string())], names=schema.names)

    restored = body.mapInArrow(run, schema)
    on_page = Window.partitionBy("page_id").orderBy("line_no")
    ended = F.lag(F.rtrim("text").rlike(r"[.?!:;)\]}]$")).over(on_page)
    gap = F.col("line_no") > F.lag("line_no").over(on_page) + 1
    starts = F.col("text").rlike(r"^\s*Q ?[0-9]+ ?[.:)]") | (gap & ended) | (F.col("code") != F.lag("code").over(on_page))
    marked = restored.withColumn("start", F.coalesce(starts, F.lit(False)))
    marked = marked.withColumn("own", F.max(F.when(F.col("start"), F.col("line_no"))).over(on_page))
    last = marked.groupBy("paper", "page_id", "page_no").agg(F.max(F.when(F.col("start"), F.col("line_no"))).alias("last_start"))
    over_pages = Window.partitionBy("paper").orderBy("page_no", "page_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per page
    carried = last.withColumn("carry", F.last(F.when(F.col("last_start").isNotNull(), F.struct("page_id", "page_no", "last_start")), ignorenulls=True).over(over_pages)).select("page_id", "carry")
    placed = marked.join(apart(carried), "page_id").select(
        "paper", "page_no", "page_id", "line_no", "text", "code", "cut",
        F.when(F.col("own").isNotNull(), F.struct("page_no", "page_id", F.col("own").alias("line_no")))
        .when(F.col("carry").isNotNull(), F.struct(F.col("carry.page_no").alias("page_no"), F.col("carry.page_id").alias("page_id"), F.col("carry.last_start").alias("line_no")))
        .otherwise(F.struct(F.lit(0).alias("page_no"), F.lit("").alias("page_id"), F.lit(0).alias("line_no"))).alias("at"),
    )
    piece = F.when(F.col("code"), F.concat("text", F.lit("\n"))).when(F.col("cut"), F.regexp_replace(F.rtrim("text"), f"[{MARKS}]$", "")).otherwise(F.concat(F.rtrim("text"), F.lit(" ")))
    one = placed.groupBy("paper", "at").agg(F.sort_array(F.collect_list(F.struct("page_no", "page_id", "line_no", piece.alias("piece")))).alias("parts"), F.count(F.lit(1)).alias("n_lines"))
    return one.select("paper", F.format_string("%06d.%06d", F.col("at.page_no"), F.col("at.line_no")).alias("paragraph"), F.rtrim(F.array_join("parts.piece", "")).alias("text"), F.col("at.page_no").alias("first_page"), "n_lines")
