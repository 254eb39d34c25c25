"""Free-entered values mapped to a reference list, by a partition-based pigeonhole join.

A reference form within ``k`` edits of a value, cut into ``k + 1`` segments, has at
least one segment that stands unchanged in the value, at most ``k`` places from
where it stands in the form.  So the segments are joined by equality with the
value's substrings at those places, and only the pairs that meet are verified
with the built-in ``levenshtein``.  Everything is SQL expressions; distinct values
are mapped once, however many rows carry them.

A value may name an entry in several ways at once (``Evaluate (L5)``): it is cut
into parts, each part is mapped, and the value stands for an entry if its parts
name exactly one.  Digits never count as typing errors of other digits.  In codes
the edits may only be marks and noughts put in, left out or exchanged ("C.O. 2",
"C311,04"); letters count as they stand, but for long words ("Course outcome").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.session import cut

UNMATCHED = "UNMATCHED"

#: Edits allowed by the length of a form: (least length, edits); and in codes.
EDITS = ((5, 2), (4, 1), (0, 0))
CODE_EDITS = 2
#: Letters of a code's word from which on they may be mistyped.
LONG_WORD = 8


def edits_for(form: Column) -> Column:
    out = F.lit(EDITS[-1][1])
    for least, k in reversed(EDITS[:-1]):
        out = F.when(F.length(form) >= least, k).otherwise(out)
    return out


def _segments(length: Column, k: Column) -> Column:
    """``array<struct<no, at, len>>``: ``k + 1`` segments of almost equal length, the longer ones last."""
    parts = k + 1
    base = F.floor(length / parts).cast("int")
    plain = (parts - length % parts).cast("int")

    def cut(i: Column) -> Column:
        at = F.when(i <= plain, i * base).otherwise(plain * base + (i - plain) * (base + 1)) + 1
        size = F.when(i < plain, base).otherwise(base + 1)
        return F.struct(i.alias("no"), at.cast("int").alias("at"), size.cast("int").alias("len"))

    return F.transform(F.sequence(F.lit(0), k.cast("int")), cut)


def _numbers(c: Column) -> Column:
    """The numbers in a text in order, without leading noughts."""
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda n: F.regexp_replace(n, "^0+(?=.)", ""))


def pigeonhole_matches(keys: DataFrame, forms: DataFrame) -> DataFrame:
    """``scope, key, ref_id, distance`` of every form within its edits of a key.

    ``keys``: distinct ``scope, key``.  ``forms``: ``scope, form, ref_id, k, loose`` (not
    ``loose``: the key's letters must be the form's).  The numbers in a form, if it has
    any, must be the key's.  ``distance`` is exact; of several forms of one entry the
    nearest counts.  Null keys match nothing.
    """
    usable = forms.filter(F.col("form").isNotNull() & (F.length("form") > F.col("k"))).withColumn("flen", F.length("form"))
    index = usable.withColumn("s", F.explode(_segments(F.col("flen"), F.col("k")))).select("scope", "form", "ref_id", "k", "loose", "flen", F.col("s.no").alias("no"), F.substring(F.col("form"), F.col("s.at"), F.col("s.len")).alias("seg"))
    shapes = usable.select("flen", "k").distinct()
    most = max(CODE_EDITS, *(k for _, k in EDITS))
    probes = (
        keys.filter(F.col("key").isNotNull())
        .withColumn("flen", F.explode(F.sequence(F.length("key") - most, F.length("key") + most)))
        .join(shapes, "flen")
        .filter(F.abs(F.length("key") - F.col("flen")) <= F.col("k"))
        .withColumn("s", F.explode(_segments(F.col("flen"), F.col("k"))))
        .withColumn("at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("s.at") - F.col("k")), F.greatest(F.lit(1), F.least(F.col("s.at") + F.col("k"), F.length("key") - F.col("s.len") + 1)))))
        .select("scope", "key", "flen", "k", F.col("s.no").alias("no"), F.substring(F.col("key"), F.col("at"), F.col("s.len")).alias("seg"))
        .distinct()
    )
    near = probes.join(index, ["scope", "flen", "k", "no", "seg"]).select("scope", "key", "form", "ref_id", "k", "loose").distinct()
    exact = near.withColumn("distance", F.levenshtein("key", "form"))
    letters = lambda c: F.regexp_replace(c, "[^A-Za-z]", "")
    same_numbers = (F.col("distance") == 0) | ~F.col("form").rlike("[0-9]") | (_numbers(F.col("key")) == _numbers(F.col("form")))
    same_letters = F.col("loose") | (letters(F.col("key")) == letters(F.col("form")))
    return exact.filter((F.col("distance") <= F.col("k")) & same_numbers & same_letters).groupBy("scope", "key", "ref_id").agg(F.min("distance").alias("distance"))


def resolve(parts: DataFrame, forms: DataFrame) -> DataFrame:
    """``scope, value, ref_id`` for each distinct value of ``parts`` (``scope, value, key``): its one entry, or ``UNMATCHED``.

    A part stands for the entries at its least distance; a value whose parts
    stand for none or for several is unmatched.  The unmatched are what an
    anti-join leaves over.
    """
    matches = cut(pigeonhole_matches(parts.select("scope", "key").distinct(), forms))
    least = matches.groupBy("scope", "key").agg(F.min("distance").alias("distance"))
    best = matches.join(least, ["scope", "key", "distance"])
    named = parts.join(best, ["scope", "key"]).groupBy("scope", "value").agg(F.collect_set("ref_id").alias("refs"))
    found = named.filter(F.size("refs") == 1).select("scope", "value", F.col("refs")[0].alias("ref_id"))
    rest = parts.select("scope", "value").distinct().join(found, ["scope", "value"], "left_anti").withColumn("ref_id", F.lit(UNMATCHED))
    return found.unionByName(rest)


def tidy(c: Column) -> Column:
    """Wide forms of digits and letters narrowed, soft hyphens gone, every kind of blank a plain one."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    narrow = "".join(chr(0x21 + i) for i in range(94))
    return F.regexp_replace(F.regexp_replace(F.translate(c, wide, narrow), "[­​‌‍﻿]", ""), r"(?U)\s+", " ")


def is_blank(c: Column) -> Column:
    return c.isNull() | F.regexp_replace(c, r"(?U)[\s­​﻿]+", "").eqNullSafe("")


# ---- names of cognitive levels


def level_keys(c: Column) -> Column:
    """The parts of a typed level: the names and the numbers ("L5") in it, as bare lower-case keys."""
    t = F.lower(tidy(c))
    t = F.regexp_replace(t, r"bloom('|’)?s?( level)?\s*[:\-]?", " ")
    t = F.regexp_replace(t, r"\b(?:bloom )?(?:l|bl|btl|lvl|level)[\s.\-#:]*([0-9]+)\b", "/l$1/")
    t = F.regexp_replace(t, r"[\s\-]+(?:level|lvl)\b", "/")
    parts = F.split(t, r"[/,;&+|()\[\]]|\band\b|\bor\b")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"[^a-z0-9@$]", "")), lambda p: p != "")


def level_forms(levels: DataFrame) -> DataFrame:
    """Forms of ``bloom_levels``: names, their other names, -ing and -yse spellings, abbreviations of four letters or more, and level numbers."""
    named = levels.select("level_id", F.lower("bloom_level").alias("w")).unionByName(levels.select("level_id", F.explode("other_names").alias("w")).withColumn("w", F.lower("w")))
    words = named.filter("w is not null").select("level_id", F.regexp_replace("w", "[^a-z0-9]", "").alias("w"))
    british = words.filter("w like '%yze'").select("level_id", F.regexp_replace("w", "yze$", "yse").alias("w"))
    base = words.unionByName(british)
    ing = base.select("level_id", F.concat(F.regexp_replace("w", "e$", ""), F.lit("ing")).alias("w"))
    whole = base.unionByName(ing).select("level_id", F.col("w").alias("form"), edits_for(F.col("w")).alias("k"))
    short = base.filter(F.length("w") > 4).select("level_id", F.explode(F.transform(F.sequence(F.lit(4), F.length("w") - 1), lambda n: F.substring("w", F.lit(1), n))).alias("form")).withColumn("k", F.lit(0))
    number = levels.select("level_id", F.concat(F.lit("l"), F.col("bloom_rank").cast("string")).alias("form"), F.lit(0).alias("k"))
    return whole.unionByName(short).unionByName(number).select(F.lit("").alias("scope"), "form", F.col("level_id").alias("ref_id"), "k", F.lit(True).alias("loose")).distinct()


# ---- codes of course outcomes

# The parts of number words and of Roman numerals.
ONES = ",ONE,TWO,THREE,FOUR,FIVE,SIX,SEVEN,EIGHT,NINE,TEN,ELEVEN,TWELVE,THIRTEEN,FOURTEEN,FIFTEEN,SIXTEEN,SEVENTEEN,EIGHTEEN,NINETEEN".split(",")
TENS = ",,TWENTY,THIRTY,FORTY,FIFTY,SIXTY,SEVENTY,EIGHTY,NINETY".split(",")
ROMAN_ONES, ROMAN_TENS = ",I,II,III,IV,V,VI,VII,VIII,IX".split(","), ",X,XX,XXX,XL,L,LX,LXX,LXXX,XC".split(",")


def _pick(names: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), i.cast("int"))


def _word(n: Column) -> Column:
    """A number below 100 in words; null from there on."""
    return F.when(n < 20, _pick(ONES, n)).otherwise(F.concat(_pick(TENS, F.floor(n / 10)), _pick(ONES, n % 10)))


def _roman(n: Column) -> Column:
    """A number below 100 in Roman numerals; null from there on."""
    return F.concat(_pick(ROMAN_TENS, F.floor(n / 10)), _pick(ROMAN_ONES, n % 10))


def _fold(c: Column) -> Column:
    """Glyphs that are read for one another in the figures of a printed code, as one."""
    return F.translate(c, "OQIL|", "00111")


def code_keys(c: Column) -> Column:
    """The parts of a typed code, upper case and without blanks, with the marks that were typed; glyphs read for figures, or for the O of CO, are folded."""
    t = F.regexp_replace(F.upper(tidy(c)), r"\bNO\b\.?", " ")
    t = F.regexp_replace(t, r"_(?=C[O0Q])", "/")
    parts = F.split(t, r"[/&+()\[\]{}]|[,;:](?!\s*[0-9])|\s-\s|\bAND\b")
    bare = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?<=[0-9])\s+(?=[0-9])", "."), r"\s+|^[^A-Z0-9|]+|[^A-Z0-9|]+$", ""))
    bare = F.transform(bare, lambda p: F.when(p.rlike(r"^C?[0-9ILOQ|]{3}[^0-9A-Z]+[0-9]+$"), _fold(p)).otherwise(p))
    bare = F.transform(bare, lambda p: F.regexp_replace(F.regexp_replace(p, r"^(C\W?)[0Q](?=\W{0,2}(?:[0-9]{1,2}|[IVX]+)$)", "$1O"), r"^(C\W?O\W?)[L|]$", "${1}1"))
    return F.filter(bare, lambda p: p != "")


def code_forms(outcomes: DataFrame) -> DataFrame:
    """Forms of ``course_outcomes`` per subject: the printed code with and without its letter, and "CO", "Outcome", "Course Outcome" with figure, numeral or word."""
    number = F.regexp_extract("short_id", r"([0-9]+)$", 1).cast("int")
    known = outcomes.select("subject", "co_id", number.alias("n")).filter("n is not null")
    n = F.col("n")
    spelled = known.select(
        "subject", "co_id", F.inline(F.array(*[F.struct(F.concat(F.lit(head), tail).alias("form"), F.lit(kind != "roman" and len(head) >= LONG_WORD).alias("loose")) for head in ("CO", "OUTCOME", "COURSEOUTCOME") for kind, tail in (("figure", n.cast("string")), ("roman", _roman(n)), ("word", _word(n)))]))
    )
    printed = outcomes.select("subject", "co_id", F.upper("printed_code").alias("form"))
    bare = printed.select("subject", "co_id", F.regexp_replace("form", "^[A-Z]+", "").alias("form"))
    every = spelled.filter("form is not null").unionByName(printed.unionByName(bare).withColumn("loose", F.lit(False)))
    return every.select(F.col("subject").alias("scope"), "form", F.col("co_id").alias("ref_id"), F.lit(CODE_EDITS).alias("k"), "loose").distinct()


# ---- whole tables


def map_labels(questions: DataFrame, levels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``id, field, ref_id`` for the typed ``bloom_level`` and ``raw_co_code`` of question rows that aren't entries as they stand.

    Rows of one id are one question (the latest ``loaded_at`` counts); null and
    blank values are no cases; a null subject has no outcomes, so its codes are
    unmatched.  Empty tables give no rows.
    """
    m = F.col("metadata")
    latest = (
        questions.filter((m["type"] == "question") & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("loaded_at", m["subject"].alias("subject"), m["bloom_level"].alias("bloom"), m["raw_co_code"].alias("code"))).alias("q"))
        .select("id", F.coalesce("q.subject", F.lit("")).alias("subject"), "q.bloom", "q.code")
    )
    typed_levels = latest.filter(~is_blank(F.col("bloom"))).join(levels.select(F.col("bloom_level").alias("bloom")), "bloom", "left_anti").select("id", F.lit("").alias("scope"), F.col("bloom").alias("value"))
    good = outcomes.select("subject", F.col("short_id").alias("code")).unionByName(outcomes.select("subject", F.col("printed_code").alias("code")))
    typed_codes = latest.filter(~is_blank(F.col("code"))).join(good, ["subject", "code"], "left_anti").select("id", F.col("subject").alias("scope"), F.col("code").alias("value"))
    typed = cut(typed_levels.select("id", F.lit("bloom_level").alias("field"), "scope", "value").unionByName(typed_codes.select("id", F.lit("raw_co_code").alias("field"), "scope", "value")))
    # each distinct value is mapped once; levels have a scope of their own
    values = typed.select("field", "scope", "value").distinct()
    keys = F.when(F.col("field") == "bloom_level", level_keys(F.col("value"))).otherwise(code_keys(F.col("value")))
    parts = cut(values.select(_scope(F.col("field"), F.col("scope")).alias("scope"), "value", F.explode_outer(keys).alias("key")).withColumn("key", F.coalesce("key", F.lit(""))))
    forms = level_forms(levels).withColumn("scope", _scope(F.lit("bloom_level"), F.lit(""))).unionByName(code_forms(outcomes).withColumn("scope", _scope(F.lit("raw_co_code"), F.col("scope"))))
    resolved = resolve(parts, cut(forms))
    return typed.withColumn("scope", _scope(F.col("field"), F.col("scope"))).join(resolved, ["scope", "value"]).select("id", "field", "ref_id")


def _scope(field: Column, scope: Column) -> Column:
    return F.concat(field, F.lit("/"), scope)
