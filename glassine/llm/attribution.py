"""Token counts by section, from one encoding of the whole document.

Encoding sections on their own miscounts, as tokens join characters across a boundary.  Here each document is
encoded once; byte-level ids add up to the text's bytes, so a running sum of each id's byte length gives every token's
span, mapped to characters.  Spans are interval-joined to the sections' character ranges, and a token that crosses a
boundary is allocated by one of RULES.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

VOCABULARY = "byte_bpe_50k.json"
#: A crossing token goes to the section of its first character, of its last, or of most of its characters (of
#: sections that hold as many the first).
RULES = ("first", "last", "most")
COLUMNS = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long"


def line_sections(text: str) -> list[int]:
    """Where each section begins if every line with its line break is one; an empty text has one section."""
    return [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))]


def token_ends(text: str, ids: np.ndarray, byte_lengths: np.ndarray) -> np.ndarray:
    """For each token the number of characters that have begun by its end."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    begun = np.r_[0, ((data & 0xC0) != 0x80).cumsum()]
    return begun[byte_lengths[ids].cumsum()]


def allocate(ends: np.ndarray, starts: np.ndarray, n_chars: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary.

    ends are the tokens' end characters, starts the sections' first ones, from 0 on.  A token without a character of
    its own (the later bytes of one) lies at the last character begun before it.
    """
    first = np.minimum(np.r_[0, ends[:-1]], np.maximum(ends - 1, 0))
    last = np.maximum(ends - 1, first)
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, last, "right") - 1
    crossing = np.flatnonzero(a != b)
    to = a if rule == "first" else b
    if rule == "most":
        to = a.copy()
        edges = np.r_[starts, n_chars]
        for i in crossing.tolist():
            cut = np.clip(edges[a[i] : b[i] + 2], first[i], last[i] + 1)
            to[i] = a[i] + int(np.diff(cut).argmax())
    n = len(starts)
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def attribute(
    docs: DataFrame,
    sections: Callable[[str], list[int]] = line_sections,
    rule: str = "first",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """One row of COLUMNS per section of each row of docs (doc_id, text).

    sections gives the first character of each section of a text, ascending from 0.  The sections of a document have
    all of its tokens between them.  A null or empty text has one section without tokens.  Repeated rows and ids are
    documents of their own; other columns are not read.  Texts are encoded whole, however long; an empty table has no
    sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenizer import encoder

        enc = encoder(vocabulary)
        lengths = enc.byte_lengths()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                parts: list[list[np.ndarray]] = [[] for _ in names[1:]]
                counts = []
                every, cuts = enc.encode(piece.column(1))
                for i, text in enumerate(piece.column(1).to_pylist()):
                    text = text or ""
                    ids = every[cuts[i] : cuts[i + 1]]
                    starts = np.array(sections(text), np.int64)
                    if len(ids):
                        n, cross = allocate(token_ends(text, ids, lengths), starts, len(text), rule)
                    else:
                        n = cross = np.zeros(len(starts), np.int64)
                    counts.append(len(starts))
                    values = (np.arange(len(starts)), starts, np.r_[starts[1:], len(text)], n, cross)
                    for column, x in zip(parts, values):
                        column.append(x)
                doc = piece.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                rest = [pa.array(np.concatenate(c), k) for c, k in zip(parts, kinds[1:])]
                yield pa.RecordBatch.from_arrays([doc, *rest], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(slim).mapInArrow(run, COLUMNS)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the tokens of every line of every document."""
    return attribute(spark.read.parquet(f"{sf_dir}/documents.parquet"))
