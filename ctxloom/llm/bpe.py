"""BPE encoding and decoding of whole texts, exactly as the tokenizers library does.

A text above LONG characters is normalised and encoded by tree concatenation:
it is halved, anywhere, also inside words, down to leaves of LEAF characters
at most; the leaves of all texts of a batch are encoded as one parallel batch;
then halves are joined level by level, all joins of a level at once, by
encoding a window around each join again, which grows until it agrees with the
left half before the join and with the right half after it. That is exact: a
token sequence is the encoding of its text if and only if every neighbouring
pair is, and the agreement leaves only pairs that one of the three encodings
contains. If no window agrees, the window is the whole node. Shorter texts are
one leaf. In leaves and windows no token of a vocabulary with word ends crosses
white space, so their pieces between it are encoded once each and remembered.

Memory is bounded by OUT_BYTES of texts or one longer text, and by CACHE
pieces, about 150 MB a worker; rows are independent, so a lost executor costs
its tasks only, and nothing is shuffled.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

#: Characters above which a text is encoded as a tree, and of a leaf at most.
LONG, LEAF = 2048, 2048
#: Characters on each side of a join in its first window.
WINDOW = 24
#: Pieces of leaves, white space aside, whose ids a worker remembers.
CACHE = 300_000
#: Bytes of texts that are encoded at once, and turned into one batch of results.
OUT_BYTES = 1_000_000
#: Lower-case Latin letters, of which NFC and lower case change none, and a mark.
_WORD = re.compile("([a-zß-öø-ÿ]+)([!-/:-@\\[-`{-~]?)")


def _latin(text: str) -> bool:
    """All Latin-1, without the blanks that it has beyond ASCII."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "\x85" not in text and "\xa0" not in text


class Codec:
    """One tokenizer file: encode(list of str) and decode(ids)."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, window: int = WINDOW, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.long, self.leaf, self.window, self.most = long, leaf, window, cache
        spec = json.loads(open(path, encoding="utf-8").read()) | {"truncation": None, "padding": None}
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # For text that is normalised already and has no special tokens.
        self.inner = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))
        self.names = [self.whole.id_to_token(i) for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        end = spec["model"].get("end_of_word_suffix") or ""
        # In the byte-level alphabet a character stands for a byte.
        self.bytes = np.array([len(n or "") - (len(end) if end and (n or "").endswith(end) else 0) for n in self.names], np.int64)
        plain = [chr(i) for i in range(256) if _latin(chr(i)) and not chr(i).isspace() or i in (28, 29, 30, 31)]
        self.lowers = self.whole.normalizer is not None and all(self.whole.normalizer.normalize_str(c) == c.lower() for c in plain)
        self.model = self.inner.model
        # The byte-level alphabet: printable bytes are themselves, the others follow from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.marks = {m: self.inner.encode(m, add_special_tokens=False).ids for m in map(chr, range(33, 127)) if not m.isalnum()}
        self._forget()

    def decode(self, ids) -> str:
        """As decode(ids, skip_special_tokens=False) of a tokenizer without a decoder: the tokens, joined by a space."""
        return " ".join(map(self.names.__getitem__, ids))

    def normal(self, text: str) -> str:
        """As the tokenizer's normalizer leaves it, but for runs of blanks, which no token holds. In Latin-1 nothing but case and blanks changes."""
        if self.lowers and _latin(text):
            for blank in "\t\n\x0b\x0c\r":
                text = text.replace(blank, " ")
            return text.lower()
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """The ids of each text, and how many joins its tree took."""
        plan: list[list] = []
        trees: list[str] = []
        for text in texts:
            own: list = []
            # Special tokens stand alone; what is between them is normalised as one.
            for i, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else [text]):
                if i % 2:
                    own.append((self.special[part], None))
                elif part:
                    own.append((None, len(trees)))
                    trees.append(self.normal(part))
            plan.append(own)
        joined, joins = self.tree(trees)
        out, taken = [], []
        for own in plan:
            parts = [np.array([special], np.int64) if n is None else joined[n] for special, n in own]
            out.append(np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.int64))
            taken.append(sum(joins[n] for _, n in own if n is not None))
        return out, taken

    def tree(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Normalised texts without special tokens: halve, encode all leaves as one batch, join upwards. The ids and the number of joins of each."""
        cuts = []
        for t in texts:
            parts = 1
            while len(t) > self.long and len(t) > parts * self.leaf:
                parts *= 2
            cuts.append([len(t) * i // parts for i in range(parts + 1)])
        leaves = [t[a:b] for t, c in zip(texts, cuts) for a, b in zip(c, c[1:])]
        found = iter(self._encode(leaves))
        nodes = [[next(found) for _ in c[1:]] for c in cuts]
        joins = [len(c) - 2 for c in cuts]
        while any(len(n) > 1 for n in nodes):
            at = [(t, i) for t, n in enumerate(nodes) if len(n) > 1 for i in range(0, len(n), 2)]
            done = self._join([(texts[t], *cuts[t][i : i + 3], nodes[t][i], nodes[t][i + 1]) for t, i in at])
            above: dict[int, list[np.ndarray]] = {}
            for (t, _), ids in zip(at, done):
                above.setdefault(t, []).append(ids)
            for t, n in above.items():
                nodes[t], cuts[t] = n, cuts[t][::2]
        return [n[0] for n in nodes], joins

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Leaves or windows as one batch; pieces that aren't known yet are encoded together."""
        split = [t.split(" ") for t in texts]
        words = list(itertools.chain.from_iterable(split))
        if len(self.rows) > self.most:
            self._forget()
        rows = np.fromiter(map(self.rows.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(new):
            unknown = [words[i] for i in new]
            self._learn(list(dict.fromkeys(unknown)))
            rows[new] = np.fromiter(map(self.rows.__getitem__, unknown), np.int64, len(new))
        size = self.size[rows]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[rows] - stop + size, size) + np.arange(int(size.sum()))]
        edges = np.cumsum([len(x) for x in split])
        return np.split(ids, stop[edges[:-1] - 1]) if len(split) else []

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.start, self.size, self.flat, self.held = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int64), 0

    def _learn(self, pieces: list[str]) -> None:
        found: list = [None] * len(pieces)
        rest, stems = [], {}
        for i, piece in enumerate(pieces):
            # Letters with at most one mark at the end are one word to the vocabulary, and the mark another.
            m = _WORD.fullmatch(piece)
            if not m:
                rest.append(i)
                continue
            stem, mark = m.groups()
            ids = stems.get(stem)
            if ids is None:
                row = self.rows.get(stem) if mark else None
                if row is None:
                    shown = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.alphabet)
                    ids = [t.id for t in self.model.tokenize(shown)]
                else:
                    ids = self.flat[self.start[row] : self.start[row] + self.size[row]].tolist()
                stems[stem] = ids
            found[i] = ids + self.marks[mark] if mark else ids
        for i, e in zip(rest, self.inner.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        first, n = len(self.rows), len(pieces)
        size = np.fromiter(map(len, found), np.int64, n)
        total = int(size.sum())
        for name, need in (("start", first + n), ("size", first + n), ("flat", self.held + total)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate((old, np.zeros(max(need, len(old)), np.int64))))
        self.size[first : first + n] = size
        self.start[first : first + n] = self.held + np.cumsum(size) - size
        self.flat[self.held : self.held + total] = np.fromiter(itertools.chain.from_iterable(found), np.int64, total)
        self.held += total
        self.rows.update(zip(pieces, range(first, first + n)))

    def _join(self, pairs: list[tuple]) -> list[np.ndarray]:
        """pairs: text, begin, middle, end, ids of the left half, ids of the right half. All windows of one width are one batch."""
        out: list = [None] * len(pairs)
        width, left_over = self.window, list(range(len(pairs)))
        while left_over:
            spans = [(max(pairs[p][1], pairs[p][2] - width), min(pairs[p][3], pairs[p][2] + width)) for p in left_over]
            windows = self._encode([pairs[p][0][a:b] for p, (a, b) in zip(left_over, spans)])
            open_ones = []
            for p, (a, b), ids in zip(left_over, spans, windows):
                out[p] = self._agreed(pairs[p], a, b, ids, 4 * width + 4)
                if out[p] is None:
                    open_ones.append(p)
            left_over, width = open_ones, 2 * width
        return out

    def _agreed(self, pair: tuple, a: int, b: int, ids: np.ndarray, near: int) -> np.ndarray | None:
        """Both halves joined by the window text[a:b], or None if it doesn't agree with them.

        Places are bytes from the join, white space not counted, of which no
        token holds any. near: more tokens than reach over half a window.
        """
        text, begin, middle, end, left, right = pair
        if a == begin and b == end:
            return ids
        tail, head = left[-near:], right[:near]
        size_l, size_r, size = self.bytes[tail], self.bytes[head], self.bytes[ids]
        at_l, at_r = np.cumsum(size_l) - size_l - size_l.sum(), np.cumsum(size_r) - size_r
        at = np.cumsum(size) - size - len(text[a:middle].replace(" ", "").encode())
        i = 0 if a == begin else self._first_common(at, ids, at_l, tail)
        j = len(ids) if b == end else self._last_common(at, ids, at_r, head)
        if i is None or j is None or i > j:
            return None
        before = left[:0] if a == begin else left[: len(left) - len(tail) + np.searchsorted(at_l, at[i])]
        after = right[:0] if b == end else right[np.searchsorted(at_r, at[j - 1]) + 1 :]
        return np.concatenate((before, ids[i:j], after))

    @staticmethod
    def _common(at, ids, other_at, other) -> np.ndarray:
        if not len(other):
            return np.zeros(len(ids), bool)
        place = np.minimum(np.searchsorted(other_at, at), len(other) - 1)
        return (other_at[place] == at) & (other[place] == ids)

    def _first_common(self, at, ids, other_at, other) -> int | None:
        """The first place, past the window's own start, from which three tokens in a row are the other's too."""
        same = self._common(at, ids, other_at, other)
        runs = np.flatnonzero(same[1:-2] & same[2:-1] & same[3:]) + 1 if len(same) > 3 else ()
        return int(runs[0]) if len(runs) else None

    def _last_common(self, at, ids, other_at, other) -> int | None:
        """One past the last such three tokens, short of the window's own end."""
        same = self._common(at, ids, other_at, other)
        runs = np.flatnonzero(same[:-3] & same[1:-2] & same[2:-1]) if len(same) > 3 else ()
        return int(runs[-1]) + 3 if len(runs) else None


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _batches(df: DataFrame, name: str, path: str, step, added: list[T.StructField]):
    small_batches(df.sparkSession)
    at = df.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            size = np.array([0 if v is None else v for v in pa.compute.binary_length(batch.column(at)).to_pylist()] if pa.types.is_string(batch.column(at).type) else [64 * len(v or ()) for v in batch.column(at).to_pylist()], np.int64)
            group = np.cumsum(size) // OUT_BYTES
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
            for x, y in zip(edges, edges[1:]):
                part = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([*part.columns, *step(c, part.column(at))], [*part.schema.names, *(f.name for f in added)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def _ids_array(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int32)))


_IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, path: str, *, text: str = "text", to: str = "ids", decoded: str | None = None, joins: str | None = None) -> DataFrame:
    """df with the token ids of every whole text and, if names are given for them, with their decoded text and the number of joins that its tree took.

    Null counts as empty; an empty text has no ids. Rows that repeat are
    encoded each. A column of df with a new column's name is replaced, others
    stay. Texts of any length are encoded whole; an empty table gives an empty
    result.
    """
    df = df.drop(*[c for c in (to, decoded, joins) if c])
    added = [T.StructField(to, _IDS)]
    added += [T.StructField(decoded, T.StringType())] if decoded else []
    added += [T.StructField(joins, T.LongType())] if joins else []

    def step(c: Codec, texts: pa.Array) -> list[pa.Array]:
        ids, taken = c.encode([(t or b"").decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()])
        out = [_ids_array(ids)]
        out += [pa.array([c.decode(i.tolist()) for i in ids], pa.string())] if decoded else []
        out += [pa.array(taken, pa.int64())] if joins else []
        return out

    return _batches(df, text, path, step, added)


def decode(df: DataFrame, path: str, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of its token ids, special tokens included; null ids count as none."""
    df = df.drop(to)
    return _batches(df, ids, path, lambda c, col: [pa.array([c.decode(v or ()) for v in col.to_pylist()], pa.string())], [T.StructField(to, T.StringType())])
