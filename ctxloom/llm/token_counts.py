"""Token counts by section: offset-mapped attribution.

A document is encoded once, whole. Its tokens are spans of bytes that cover
it; its sections are spans too. A token is allotted to the section it lies in,
and one that crosses a boundary by an explicit rule:

- "most": to the section that holds most of its bytes, ties to the earlier;
- "start": to the section in which it starts.

Counting section by section would instead split such tokens and count more
than the document has. The join of spans is a binary search over sorted ends
in numpy; a row is a document, and nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allot(lengths: np.ndarray, ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """Tokens by section, and how many cross a boundary. lengths: bytes of the tokens, in order; ends: where sections end, ascending, the last at the end of the text. A section without bytes gets no token."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    first = np.searchsorted(ends, start, side="right")
    last = np.searchsorted(ends, stop, side="left")
    crossing = np.flatnonzero(last > first)
    to = np.minimum(first, len(ends) - 1)
    if rule == "most":
        for t in crossing:
            edges = np.concatenate(([start[t]], ends[first[t] : last[t]], [stop[t]]))
            to[t] = first[t] + int(np.argmax(np.diff(edges)))
    elif rule != "start":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(to, minlength=len(ends)), len(crossing)


def lines(text: Column) -> Column:
    """Sections of a text that are its lines, each with its line end: their lengths in code points."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "(?<=\n)", -1), lambda s: F.length(s))


def count_tokens(df: DataFrame, path: str, pattern: str, *, sections: str, text: str = "text", rule: str = "most") -> DataFrame:
    """df with n_tokens, section_tokens (array, one entry a section) and n_crossing.

    sections names an array column of section lengths in code points that add
    up to the text; what they leave over at the end joins the last one. A null
    or empty text has no tokens; null or empty sections count as one section.
    Rows that repeat are counted each; an empty table gives an empty result.
    Columns of df with the new names are replaced.
    """
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("section_tokens", T.ArrayType(T.LongType())), T.StructField("n_crossing", T.LongType())]
    small_batches(df.sparkSession)
    df = df.drop(*[f.name for f in new])
    at, cut = df.columns.index(text), df.columns.index(sections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = _encoder(path, pattern)
        for batch in batches:
            total, each, crossing = [], [], []
            for t, own in zip(batch.column(at), batch.column(cut).to_pylist()):
                raw = t.as_py() or ""
                raw = raw.decode(errors="replace") if isinstance(raw, bytes) else raw
                ids = encoder.encode_ordinary(raw)
                chars = np.cumsum([x or 0 for x in own or [len(raw)]])
                if raw.isascii():
                    ends, whole = chars, len(raw)
                else:
                    data = np.frombuffer(raw.encode(), np.uint8)
                    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    ends, whole = begins[np.minimum(chars, len(begins) - 1)], len(data)
                ends = np.minimum(ends, whole)
                ends[-1] = whole
                counts, n = allot(size[ids], ends, rule)
                total.append(len(ids)), each.append(counts), crossing.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.int64()), pa.array(each, pa.list_(pa.int64())), pa.array(crossing, pa.int64())], [*batch.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))
