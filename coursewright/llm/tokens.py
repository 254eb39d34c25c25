"""Byte-pair encoding of a corpus by dynamic programming over prefixes.

For a fixed rank table every byte prefix of a piece has exactly one encoding,
so it is described by one number: the last token of that encoding.  The entry
for prefix ``i`` is the longest token ``t`` ending at ``i`` such that the entry
of prefix ``i - len(t)`` and ``t`` may stand side by side.  Whether two tokens
may stand side by side depends on their merge histories alone.  The table of
last tokens grows at its end without touching what is there (exact appends),
and after an edit only the pieces around it are worked out anew.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k"

# Fixed value: the published split pattern of the byte-level vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A split may look this many characters past a piece's end ("'ll").
LOOKAHEAD = 2

#: Pieces remembered per worker; beyond it the memory starts afresh (the result doesn't change).
MEMO_PIECES = 400_000
#: Pieces longer than this aren't remembered.
MEMO_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of base64 and number per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """Encodes pieces by last-token tables; one object per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern)
        self.length = {r: len(b) for b, r in ranks.items()}
        self.parents: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = self._history(token, rank)
                if halves:
                    self.parents[rank] = halves
                    self.merged[halves] = rank
        self._beside: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, list[int]] = {}

    def _history(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``: the one cut at which both sides are tokens of lower rank that may stand side by side."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is not None and right is not None and left < rank and right < rank:
                if self._may_stand(left, right, rank):
                    return left, right
        return None

    def _may_stand(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether no merge with a rank under ``before`` joins the end of ``left`` to the start of ``right``.

        Walks both merge histories back in time.  At each step the facing tokens
        ``a`` and ``b`` exist until the earlier of ``a_dies`` and ``b_dies``; a merge of
        the two that comes first would have crossed the seam.  On equal ranks the
        merge further left comes first.
        """
        never = 1 << 60
        a, b, a_dies, b_dies = left, right, never if before is None else before, never if before is None else before
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < a_dies and joined <= b_dies and (before is None or joined < before):
                return False
            a_parts, b_parts = self.parents.get(a), self.parents.get(b)
            if a_parts is None and b_parts is None:
                return True
            if b_parts is None or (a_parts is not None and a >= b):
                a_dies, a = a, a_parts[1]
            else:
                b_dies, b = b, b_parts[0]

    def may_stand(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` is the encoding of their joint bytes."""
        key = (left, right)
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > 2_000_000:
                self._beside.clear()
            known = self._beside[key] = self._may_stand(left, right)
        return known

    def extend(self, last: list[int], data: bytes, start: int = 0) -> list[int]:
        """Adds the entries of ``data``'s prefixes longer than ``start`` to the table ``last`` (entry ``i`` is that of prefix ``i + 1``)."""
        ranks, length = self.ranks, self.length
        for end in range(start + 1, len(data) + 1):
            for size in range(min(self.longest, end), 0, -1):
                token = ranks.get(data[end - size : end])
                if token is None:
                    continue
                if size == end or self.may_stand(last[end - size - 1], token):
                    if size == 1 or token in self.parents:
                        last.append(token)
                        break
            else:
                raise ValueError("the rank table lacks a byte")
        return last

    def read_off(self, last: list[int]) -> list[int]:
        """The encoding that a table stands for."""
        ids, end = [], len(last)
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= self.length[token]
        ids.reverse()
        return ids

    def piece(self, text: str) -> list[int]:
        known = self._memo.get(text)
        if known is None:
            data = text.encode("utf-8")
            whole = self.ranks.get(data)
            known = [whole] if whole is not None and (len(data) == 1 or whole in self.parents) else self.read_off(self.extend([], data))
            if len(data) <= MEMO_BYTES:
                if len(self._memo) >= MEMO_PIECES:
                    self._memo.clear()
                self._memo[text] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        """Token ids without special tokens; empty for an empty or null text."""
        ids: list[int] = []
        if text:
            memo, piece = self._memo, self.piece
            for p in self.split.findall(text):
                ids += memo.get(p) or piece(p)
        return ids

    def count(self, text: str | None) -> int:
        """How many ids :meth:`encode` gives."""
        if not text:
            return 0
        memo, piece = self._memo, self.piece
        return sum(len(memo.get(p) or piece(p)) for p in self.split.findall(text))


class EncodedText:
    """A text with its pieces and their last-token tables, for appends and edits."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.worked = 0  # bytes whose entries were worked out
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from ``start`` to ``end``; splits anew from the last piece the edit can't reach until the splits agree again."""
        old, shift = self.text, len(new) - (end - start)
        text = old[:start] + new + old[end:]
        k = bisect.bisect_left(self.starts, start - LOOKAHEAD)
        k = max(0, k - 1)
        at = self.starts[k] if self.starts else 0
        old_at = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, tables, tail = self.starts[:k], self.tables[:k], None
        old_tables = dict(zip(self.starts[k:], self.tables[k:], strict=True))
        bounds = {s: (self.starts[i + 1] if i + 1 < len(self.starts) else len(old)) for i, s in enumerate(self.starts)}
        for m in self.encoder.split.finditer(text, at):
            s, p = m.start(), m.group()
            if s >= start + len(new) and s in old_at:
                tail = old_at[s]
                break
            data = p.encode("utf-8")
            table: list[int] = []
            known = old_tables.get(s)
            if known is not None:  # the unchanged prefix of the piece keeps its entries
                was, same = old[s : bounds[s]], 0
                while same < len(p) and same < len(was) and p[same] == was[same]:
                    same += 1
                table = known[: len(p[:same].encode("utf-8"))]
            self.worked += len(data) - len(table)
            self.encoder.extend(table, data, len(table))
            starts.append(s)
            tables.append(table)
        if tail is not None:
            starts += [s + shift for s in self.starts[tail:]]
            tables += self.tables[tail:]
        self.text, self.starts, self.tables = text, starts, tables

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.encoder.read_off(t)]


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder_for(vocabulary: str = DEFAULT_VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR) -> PrefixEncoder:
    """The worker's encoder of a rank file, built once per process."""
    path = os.path.join(tokenizer_dir, vocabulary + ".tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(read_ranks(path))
    return _ENCODERS[path]


def _texts(column: pa.Array) -> Iterator[str | None]:
    for x in column:
        yield x.as_py()


def encode_column(df: DataFrame, id_cols: Iterable[str], text_col: str, out_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``id_cols`` and the list of token ids of ``text_col``.

    One row out per row in, repeated rows included; a null or empty text gives an
    empty list; any further columns are left out, so their names can't clash.
    """
    id_cols = list(id_cols)
    schema = T.StructType([df.schema[c] for c in id_cols] + [T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(vocabulary, tokenizer_dir)
        for batch in batches:
            offsets, flat = [0], []
            for text in _texts(batch.column(len(id_cols))):
                flat += enc.encode(text)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(offsets, dtype=np.int32)), pa.array(np.asarray(flat, dtype=np.int32), type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(id_cols))), ids], names=[*id_cols, out_col])

    return df.select(*id_cols, text_col).mapInArrow(run, schema)


def count_column(df: DataFrame, id_cols: Iterable[str], text_col: str, out_col: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``id_cols`` and the number of tokens of ``text_col``; 0 for a null or empty text."""
    id_cols = list(id_cols)
    schema = T.StructType([df.schema[c] for c in id_cols] + [T.StructField(out_col, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(vocabulary, tokenizer_dir)
        for batch in batches:
            n = pa.array([enc.count(t) for t in _texts(batch.column(len(id_cols)))], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(id_cols))), n], names=[*id_cols, out_col])

    return df.select(*id_cols, text_col).mapInArrow(run, schema)


def decode_bytes(ids: Iterable[int], ranks: dict[bytes, int]) -> bytes:
    """The bytes that ids stand for (round-trip checks)."""
    back = {r: b for b, r in ranks.items()}
    return b"".join(back[i] for i in ids)


__all__ = ["EncodedText", "PrefixEncoder", "count_column", "decode_bytes", "encode_column", "encoder_for", "read_ranks"]
