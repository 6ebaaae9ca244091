"""Token counts: batch encoding in Arrow functions that return lengths only.

Every text is split where a token can never cross: before white space that follows
another character, and after a lone line feed before another character. In byte-level
BPE vocabularies with the usual pre-tokenisation white space is either the first
character of a token or part of a run of it, so the pieces' lengths add up to the
text's length, and a special string (which holds neither) stays in one piece. A piece
without white space has no safe boundary inside: however long, it is never split.
Texts are gathered to batches of about ``batch_bytes``; the library encodes each
distinct piece that the worker doesn't know yet once, and only lengths are kept.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, distinct_names, read

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
BATCH_BYTES = 1 << 20
#: Pieces of up to this many characters are remembered, and so many of them.
PIECE_CHARS = 40
PIECES = 300_000
#: Bytes of plain pieces in one text.
LINES_BYTES = 1000

SAFE = re.compile(r"(?<=\S)(?=\s)")
#: Texts that plain splitting at spaces and line feeds serves: no two white-space characters meet, none stands at an end.
UNEVEN = re.compile(r"\s(?:\s|\Z)|\A\s|[^\S \n]")
#: A piece whose only white space is one space before it: many of them go into one call, a line each.
PLAIN = re.compile(r" ?\S+")
SCHEMA = "n_bytes long, n_tokens long"


class Counter:
    """Counts tokens with the public library, remembering the lengths of short pieces."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bare: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        alone = self.encoded(["\n", "a\n", "a\n a"])
        single = len(alone[0]) == 1 and alone[1].ids[-1:] == alone[0].ids and alone[0].ids[0] in alone[2].ids
        self.line_feed = alone[0].ids[0] if single else None

    def encoded(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def lengths(self, pieces: list[str]) -> list[int]:
        """The length of each piece. A line feed after a plain piece is a token of its own, so such pieces share a text."""
        plain = [p for p in pieces if PLAIN.fullmatch(p)] if self.line_feed is not None else []
        found: dict[str, int] = {}
        groups = list(by_bytes(plain, LINES_BYTES))
        for group, e in zip(groups, self.encoded(["\n".join(g) + "\n" for g in groups]), strict=True):
            ends = np.flatnonzero(np.array(e.ids) == self.line_feed)
            found.update(zip(group, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))
        rest = [p for p in pieces if p not in found] if len(plain) < len(pieces) else []
        found.update(zip(rest, map(len, self.encoded(rest)), strict=True))
        return [found[p] for p in pieces]

    @staticmethod
    def pieces(text: str) -> tuple[list[str], list[str]]:
        """The text cut at safe boundaries: pieces as they are, and, without their first space, those that begin with one."""
        if UNEVEN.search(text):
            parts = SAFE.split(text)
            return [p for p in parts if p[:1] != " "], [p[1:] for p in parts if p[:1] == " "]
        bare, spaced = [], []
        for line in text.split("\n"):
            parts = line.split(" ")
            bare += parts[0], "\n"
            spaced += parts[1:]
        bare.pop()
        return bare, spaced

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) if t else ([], []) for t in texts]
        for known, which, head in ((self.bare, 0, ""), (self.spaced, 1, " ")):
            if len(known) > PIECES:
                known.clear()
            new = list(set().union(*(s[which] for s in split)).difference(known))
            known.update(zip(new, self.lengths([head + p for p in new]), strict=True))
        counts = [sum(map(self.bare.__getitem__, a)) + sum(map(self.spaced.__getitem__, b)) for a, b in split]
        for known, which in ((self.bare, 0), (self.spaced, 1)):
            for p in {p for s in split for p in s[which] if len(p) > PIECE_CHARS}:
                del known[p]
        return counts


def by_bytes(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """The texts in order, in batches of at most ``limit`` bytes (in UTF-8) or a single text."""
    batch, held = [], 0
    for t in texts:
        n = len(t) if t.isascii() else len(t.encode())
        if batch and held + n > limit:
            yield batch
            batch, held = [], 0
        batch.append(t)
        held += n
    if batch:
        yield batch


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, keys: list[str], text: str = "text", vocabulary: str = VOCABULARY, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``keys`` plus n_bytes and n_tokens of ``text``, one row for each row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens). Texts are never cut short; a
    text of any length is counted whole. Repeated rows give repeated results, an
    empty table an empty one; columns not in ``keys`` are ignored; a key with the name
    of a result is refused.
    """
    distinct_names(keys, ["n_bytes", "n_tokens"])
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        counter = _counters[vocabulary]
        for b in batches:
            texts = [t or "" for t in b.column(len(keys)).to_pylist()]
            n = [c for part in by_bytes(texts, batch_bytes) for c in counter.count(part)]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(size, pa.int64()), pa.array(n, pa.int64())], [*keys, "n_bytes", "n_tokens"])

    chosen = docs.select(*keys, F.col(text).alias("__text"))
    head = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[: len(keys)])
    return chosen.mapInArrow(run, f"{head}, {SCHEMA}")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has over ``LIMIT`` tokens; null texts have none."""
    docs = read(spark, sf_dir, "documents")
    return count_tokens(docs, ["doc_id"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)
