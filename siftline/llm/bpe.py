"""BPE encoding by a pair occurrence index, and decoding.

A slice of a batch, of about 4 MB of texts, is cut into white-space pieces; the words of its pieces that
the worker has not met yet lie one after another in one array of symbols. An index maps each mergeable pair, by its rank, to all its
positions. Ranks that occur are applied in ascending order with one array operation for all
positions of a pair; only the lists of the pairs beside a merge are updated.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters whose normal form, lower case and class are the same in every Unicode version in use.
_SIMPLE = re.compile("[\x21-\x7eÀ-įı-ſ]+")


class PieceMemory:
    """Ids of the white-space pieces seen so far. White space in ASCII cuts a text into pieces: no word
    reaches over it, and neither does normalization, so the ids of a text are those of its pieces."""

    #: Pieces kept at most, before all are forgotten.
    most = 800_000

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in one array, and where each piece's end."""
        raise NotImplementedError

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all UTF-8 texts in one array, and where each text starts in it (one more place at the end)."""
        if len(self.known) > self.most:
            self.forget()
        known, seen = self.known, len(self.known)
        codes: list[int] = []
        bounds = [0]
        for text in texts:
            # Lower-casing is part of the vocabulary's normalization; only an added token could show the difference.
            pieces = (text if b"<|" in text else text.lower()).split() if text else []
            try:
                codes += map(known.__getitem__, pieces)
            except KeyError:
                del codes[bounds[-1] :]
                codes += [known.setdefault(p, len(known)) for p in pieces]
            bounds.append(len(codes))
        if len(known) > seen:
            flat, ends = self.learn(list(islice(known, seen, None)))
            self.starts = np.concatenate((self.starts, ends + len(self.flat)))
            self.flat = np.concatenate((self.flat, flat))
        at = np.array(codes, np.int64)
        size = self.starts[at + 1] - self.starts[at]
        return gathered(self.flat, self.starts[at], size), np.concatenate(([0], np.cumsum(size)))[np.array(bounds)]


class PairIndexBPE(PieceMemory):
    """A tokenizer file of the kind BPE with word ends, applied to many texts at once."""

    most = 250_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # for its normalizer and pre-tokenizer on rare characters
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = np.empty(size, object)
        for word, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = word.encode()
        shown = _byte_characters()
        self.character = {c: b for b, c in shown.items()}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[shown[b] + self.end] for b in range(256)], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.radix = np.int64(size)
        keys = np.array([a * size + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([c for _, _, c in pairs], np.int32)
        self.twins = {r for r, (a, b, _) in enumerate(pairs) if a == b}
        super().__init__()

    # --- text to words ---

    def words(self, piece: str) -> list[bytes | int]:
        """UTF-8 of the words of a piece, or the id of an added token."""
        out: list[bytes | int] = []
        for part in self.split_added.split(piece) if self.split_added and "<" in piece else [piece]:
            if part in self.added:
                out.append(self.added[part])
            elif _SIMPLE.fullmatch(part):
                out += [w.encode() for w in self.pattern.findall(part.lower())]
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                out += [bytes(self.character[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    # --- words to ids ---

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left.astype(np.int64) * self.radix + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(-1))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word starts in it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        # One more place at the end stands for "no neighbour".
        ahead, back = np.arange(1, n + 2), np.arange(-1, n)
        ahead[ends - 1] = n
        back[ends - lengths] = n
        alive = np.ones(n, bool)
        rank = np.full(n + 1, -1, np.int32)
        inside = np.flatnonzero(ahead[:n] < n)
        rank[inside] = self.ranked(symbol[inside], symbol[inside + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            r = rank[positions]
            order = np.argsort(r, kind="stable")
            positions, r = positions[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            firsts = r[np.concatenate(([0], cuts))].tolist() if len(r) else []
            bounds = [0, *cuts.tolist(), len(r)]
            for i, one in enumerate(firsts):
                if one >= 0:
                    found = index.get(one)
                    if found is None:
                        index[one] = [positions[bounds[i] : bounds[i + 1]]]
                        heapq.heappush(heap, one)
                    else:
                        found.append(positions[bounds[i] : bounds[i + 1]])

        enter(inside)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if r in self.twins and len(at) > 1:
                at, taken = np.sort(at), -1
                keep = []
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = int(ahead[p])
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = ahead[at]
            after = ahead[gone]
            symbol[at] = self.merged[r]
            alive[gone] = False
            rank[gone] = -1
            ahead[at] = after
            inner = after < n
            back[after[inner]] = at[inner]
            rank[at] = -1
            right = at[inner]
            if len(right):
                rank[right] = self.ranked(symbol[right], symbol[after[inner]])
            before = back[at]
            left = before[before < n]
            if len(left):
                rank[left] = self.ranked(symbol[left], symbol[ahead[left]])
                right = np.concatenate((right, left))
            if len(right):
                right = right[rank[right] >= 0]
                if len(right) == 1:
                    one = int(rank[right[0]])
                    if one in index:
                        index[one].append(right)
                    else:
                        index[one] = [right]
                        heapq.heappush(heap, one)
                elif len(right):
                    enter(np.unique(right))
        kept = np.concatenate(([0], np.cumsum(alive)))
        return symbol[alive], kept[np.concatenate(([0], ends))]

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.words(p.decode()) for p in pieces]
        distinct: dict[bytes | int, int] = {}
        order = np.array([distinct.setdefault(w, len(distinct)) for ws in split for w in ws], np.int64)
        plain = [w for w in distinct if isinstance(w, bytes)]
        flat, starts = self.merge(plain)
        added = [w for w in distinct if isinstance(w, int)]
        is_plain = np.array([isinstance(w, bytes) for w in distinct], bool)
        place, size = np.zeros(len(distinct), np.int64), np.ones(len(distinct), np.int64)
        place[is_plain], size[is_plain] = starts[:-1], np.diff(starts)
        place[~is_plain] = len(flat) + np.arange(len(added))
        flat = np.concatenate((flat, np.array(added, np.int32)))
        ids = gathered(flat, place[order], size[order])
        words = np.cumsum([len(ws) for ws in split])
        return ids, np.concatenate(([0], np.cumsum(size[order])))[words]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens with a space between, as the library's decode without a decoder."""
        return b" ".join(self.tokens[ids].tolist())


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start+size] of every row, joined."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    begin = np.cumsum(size) - size
    return flat[np.repeat(start - begin, size) + np.arange(total)]


_LOADED: dict[str, PairIndexBPE] = {}


def loaded(path: str) -> PairIndexBPE:
    """One tokenizer for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBPE(path)
    return _LOADED[path]


def small_slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least, and their texts."""
    column = batch.column(text)
    texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
    sizes = np.array([len(x) if x else 0 for x in texts], np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a), texts[a:b]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Add the token ids of the whole text and their number to each row; row order and other columns stay.

    Null and empty texts have no ids. Columns named like the new ones are replaced. Repeated rows
    each get their ids; an empty table gives an empty table. ``path``: the tokenizer's file, which
    every executor can read.
    """
    from pyspark.sql import types as T

    rest = docs.drop(ids, n_tokens)
    schema = T.StructType([*rest.schema.fields, T.StructField(n_tokens, T.LongType()), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    place = rest.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part, texts in small_slices(batch, place):
                flat, starts = bpe.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(starts)), lists], [*part.schema.names, n_tokens, ids])
        bpe.forget()  # the worker lives on and serves other stages

    return rest.mapInArrow(encode, schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (little-endian, 32 bits) and of their decoded text.

    Null and empty texts have no ids and decode to an empty text. Null ids stay; repeated rows each
    get their row; an empty table gives an empty table. Further columns of docs are not returned.
    """
    import hashlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part, texts in small_slices(batch, 1):
                flat, starts = bpe.encode(texts)
                rows = [flat[a:b] for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(starts)),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in rows], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded text of an array of ids; null gives null, no ids give an empty text.

    Repeated rows each get their text; an empty table gives an empty table. A column named like the new one is replaced.
    """

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        bpe = loaded(path)
        return column.map(lambda x: None if x is None else bpe.decode(np.asarray(x, np.int64)).decode())

    return encoded.withColumn(out, decoded(F.col(ids)))
