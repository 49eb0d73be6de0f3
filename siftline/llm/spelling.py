"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One inserted letter raises one letter count by one; one replaced letter lowers one and raises one.
So the words near a word lie in a small box around its letter counts: those of its own length, and
those one letter longer. The tops of the trees, one for each length, are cut on a bounded sample of
the vocabulary and give cells; every word goes to its own cell and asks the cells whose box its
search reaches. A task builds the rest of the tree over the words of a cell, prunes by the boxes of
its nodes, and compares the letters' order in the leaves. Large cells are cut into slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.bpe import small_slices
from siftline.llm.common import drop_all, written

RUN = regex.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Column of each letter of a lower-cased run, by its code point.
_COLUMN = np.zeros(256, np.uint8)
_COLUMN[97:123] = np.arange(26)
_COLUMN[192:256] = np.arange(26, 90)
LETTERS = 90


@dataclass(frozen=True)
class Rules:
    least_letters: int = 5
    least_times: int = 3
    #: One run in so many of those that the hash of document and run chooses loses a letter; 0: none does.
    typo_modulus: int = 97
    #: A form occurs at least so many times as often as the word.
    form_ratio: int = 2
    #: Words of the bounded sample that the cells are cut on, and cells at most.
    sampled: int = 50_000
    most_cells: int = 4096
    #: Words of a cell's slice.
    slice_words: int = 16_384
    #: Distinct runs that a worker keeps before it hands their counts on.
    held_runs: int = 300_000


# --- counting -------------------------------------------------------------------------------------


class _Shift:
    """crc32 of a prefix followed by a run of n bytes, from the crc32 of both (crc32 is linear)."""

    def __init__(self) -> None:
        self.tables: dict[int, np.ndarray] = {}

    def table(self, n: int) -> np.ndarray:
        if n not in self.tables:
            zeros = bytes(n)
            base = zlib.crc32(zeros)
            values = np.fromiter((zlib.crc32(zeros, v << (8 * k)) ^ base for k in range(4) for v in range(256)), np.uint32, 1024)
            if n > 512:
                return values.reshape(4, 256)
            self.tables[n] = values.reshape(4, 256)
        return self.tables[n]

    def joined(self, prefix: np.ndarray, run: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = run.copy()
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order])) + 1
        for at in np.split(order, edges):
            if len(at):
                t, p = self.table(int(size[at[0]])), prefix[at]
                out[at] ^= t[0][p & 255] ^ t[1][(p >> 8) & 255] ^ t[2][(p >> 16) & 255] ^ t[3][p >> 24]
        return out


class _Counts:
    """Counts of the words of a task's documents."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.shift = rules, _Shift()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.low: list[str] = []
        self.crc: list[int] = []
        self.size: list[int] = []
        self.n = np.zeros(0, np.int64)
        self.short: dict[str, int] = {}

    def add(self, ids: list, texts: list[bytes | None]) -> None:
        codes: list[int] = []
        bounds, known = [0], self.known
        for text in texts:
            runs = RUN.findall(text.decode()) if text else []
            try:
                codes += map(known.__getitem__, runs)
            except KeyError:
                del codes[bounds[-1] :]
                codes += [known.setdefault(r, len(known)) for r in runs]
            bounds.append(len(codes))
        for run in list(known)[len(self.low) :] if len(known) > len(self.low) else ():
            low = run.translate(_LOWER)
            raw = low.encode()
            self.low.append(low)
            self.crc.append(zlib.crc32(raw))
            self.size.append(len(raw))
        if len(self.n) < len(known):
            self.n = np.concatenate((self.n, np.zeros(len(known) - len(self.n), np.int64)))
        if not codes:
            return
        at = np.array(codes, np.int64)
        if self.rules.typo_modulus:
            prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
            prefix = np.repeat(prefix, np.diff(bounds))
            hashes = self.shift.joined(prefix, np.array(self.crc, np.uint32)[at], np.array(self.size, np.int64)[at])
            cut = hashes % self.rules.typo_modulus == 0
            for code, h in zip(at[cut].tolist(), hashes[cut].tolist(), strict=True):
                low = self.low[code]
                k = h % len(low)
                word = low[:k] + low[k + 1 :]
                if len(word) >= self.rules.least_letters:
                    self.short[word] = self.short.get(word, 0) + 1
            at = at[~cut]
        self.n += np.bincount(at, minlength=len(self.n))

    def batch(self) -> pa.RecordBatch:
        total = self.short
        for low, n in zip(self.low, self.n.tolist(), strict=True):
            if n and len(low) >= self.rules.least_letters:
                total[low] = total.get(low, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """word and n, the number of its occurrences in all texts; short and rare words are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(rules)
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for part, texts in small_slices(batch, 1):
                counts.add(ids[done : done + len(part)], texts)
                done += len(part)
                if len(counts.known) + len(counts.short) >= rules.held_runs:
                    yield counts.batch()
                    counts.forget()
        if counts.known:
            yield counts.batch()

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.least_times)


# --- trees ----------------------------------------------------------------------------------------


def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length, in latin-1, as a matrix."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    """Letter counts up to 255 of words of one length; a cut-off count keeps distances no larger."""
    n, length = rows.shape
    flat = np.repeat(np.arange(n) * LETTERS, length) + _COLUMN[rows.ravel()]
    return np.minimum(np.bincount(flat, minlength=n * LETTERS).reshape(n, LETTERS), 255).astype(np.uint8)


def _halved(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and the largest count of the lower half, for the most even cut of the widest letter; None if all rows are equal."""
    spread = counts.var(0)
    d = int(spread.argmax())
    if spread[d] == 0:
        return None
    share = np.cumsum(np.bincount(counts[:, d]))
    inner = np.flatnonzero((share > 0) & (share < len(counts)))
    return d, int(inner[np.abs(share[inner] - len(counts) / 2).argmin()])


class Tree:
    """A k-d tree over letter counts, with the bounding box of each node; leaves hold places of rows."""

    leaf = 24

    def __init__(self, counts: np.ndarray) -> None:
        #: Of each node: the letters that any of its rows has, and their smallest and largest counts as columns.
        self.boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        todo = [(np.arange(len(counts)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            node, own = len(self.boxes), counts[at]
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            lo, hi = own.min(0), own.max(0)
            used = np.flatnonzero(hi)
            self.boxes.append((used[:, None], lo[used, None], hi[used, None]))
            self.members.append(at)
            self.children.append(None)
            cut = _halved(own) if len(at) > self.leaf else None
            if cut is not None:
                left = own[:, cut[0]] <= cut[1]
                todo += [(at[left], node, 0), (at[~left], node, 1)]

    def reached(self, counts: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of rows of each leaf that their box search reaches.

        Rows as long as the query have one letter more and one less; longer ones have one more.
        """
        todo = [(0, np.arange(len(counts)))]
        columns, total = np.ascontiguousarray(counts.T), counts.sum(1, dtype=np.int32)
        while todo:
            node, at = todo.pop()
            used, lo, hi = self.boxes[node]
            own = columns[used, at]
            more = (np.maximum(own, lo) - own).sum(0, dtype=np.int32)
            less = total[at] - np.minimum(own, hi).sum(0, dtype=np.int32)
            at = at[(more <= 1) & (less == 0 if longer else less <= 1)]
            if not len(at):
                continue
            if self.children[node] is None:
                yield at, self.members[node]
            else:
                todo += [(child, at) for child in self.children[node]]


def one_edit(a: np.ndarray, b: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a and b that differ by one replaced letter, or by one inserted in b."""
    if not longer:
        return np.nonzero((a[:, None] != b[None]).sum(2) == 1)
    head = np.logical_and.accumulate(a[:, None] == b[None, :, :-1], axis=2).sum(2)
    tail = np.logical_and.accumulate((a[:, None] == b[None, :, 1:])[:, :, ::-1], axis=2).sum(2)
    return np.nonzero(head + tail >= a.shape[1])


class Cells:
    """The tops of the trees: boxes that share out the letter counts of each length."""

    def __init__(self, sample: list[str], total: int, rules: Rules) -> None:
        self.rules = rules
        by_length: dict[int, list[bytes]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word.encode("latin-1"))
        least = max(rules.slice_words * 0.7 * len(sample) / max(total, 1), 2 * len(sample) / rules.most_cells)
        self.lo, self.hi, lengths = [], [], []
        for length, words in sorted(by_length.items()):
            todo = [(letter_counts(letters(words)), np.zeros(LETTERS, np.uint8), np.full(LETTERS, 255, np.uint8))]
            while todo:
                counts, lo, hi = todo.pop()
                cut = _halved(counts) if len(counts) > least else None
                if cut is None:
                    self.lo.append(lo)
                    self.hi.append(hi)
                    lengths.append(length)
                    continue
                d, value = cut
                left, up, down = counts[:, d] <= value, lo.copy(), hi.copy()
                up[d], down[d] = value + 1, value
                todo += [(counts[left], lo, down), (counts[~left], up, hi)]
        #: Cells of each length, whose numbers follow each other; lengths that the sample lacks have one cell without bounds.
        self.of: dict[int, np.ndarray] = {n: np.flatnonzero(np.array(lengths) == n) for n in set(lengths)}
        self.slices: dict[int, int] = {}

    def numbers(self, length: int) -> np.ndarray:
        return self.of.get(length, np.array([-length]))

    def distances(self, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters that a row lacks and has over for each cell of a length."""
        if length not in self.of:
            return np.zeros((len(counts), 1), np.int64), np.zeros((len(counts), 1), np.int64)
        more, less = [], []
        for cell in self.of[length]:
            lo, hi = self.lo[cell], self.hi[cell]
            more.append((np.maximum(counts, lo) - counts).sum(1, dtype=np.int64))
            less.append((np.maximum(counts, hi) - hi).sum(1, dtype=np.int64))
        return np.stack(more, 1), np.stack(less, 1)

    def own(self, counts: np.ndarray, length: int) -> np.ndarray:
        more, less = self.distances(counts, length)
        return self.numbers(length)[((more + less) == 0).argmax(1)]


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    sizes = np.array(list(map(len, words)), np.int64)
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield int(length), at, [words[i].encode("latin-1") for i in at]


def _slice_of(words: list[bytes], slices: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % slices for w in words), np.int64, len(words)) if slices > 1 else np.zeros(len(words), np.int64)


POINT, SAME, SHORTER = 0, 1, 2
_DEALT = "cell long, slice long, role int, word string, n long"
_PARTS = "word string, n_near long, best_n long, best string"


def _dealt(cells: Cells, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word as a point of its cell, and as a query to the slices that it asks.

    Of two slices of one length the smaller asks the larger, so that no pair is met twice.
    """
    for batch in batches:
        column, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for length, at, words in _by_length(column):
            counts = letter_counts(letters(words))
            own = cells.own(counts, length)
            inside = np.zeros(len(at), np.int64)
            for cell in np.unique(own):
                here = np.flatnonzero(own == cell)
                inside[here] = _slice_of([words[i] for i in here], cells.slices.get(int(cell), 1))
            out = [(own, inside, POINT, at)]
            for other, role in ((length, SAME), (length + 1, SHORTER)):
                more, less = cells.distances(counts, other)
                for j, cell in enumerate(cells.numbers(other)):
                    if int(cell) not in cells.slices:
                        continue  # no word lies there
                    meets = (more[:, j] <= 1) & (less[:, j] == 0 if role == SHORTER else (less[:, j] <= 1) & (own <= cell))
                    for s in range(cells.slices[int(cell)]):
                        asks = np.flatnonzero(meets if role == SHORTER else meets & ((own < cell) | (inside < s)))
                        if len(asks):
                            out.append((np.full(len(asks), cell), np.full(len(asks), s), role, at[asks]))
            rows = np.concatenate([x[3] for x in out])
            role = np.repeat(np.array([x[2] for x in out], np.int32), [len(x[3]) for x in out])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out])), pa.array(role), batch.column(0).take(pa.array(rows)), pa.array(n[rows])], ["cell", "slice", "role", "word", "n"])


class _Near:
    """For each of some words: how many near words were met, and the most frequent of them."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.n_near = np.zeros(len(words), np.int64)
        self.best_n = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), b"", object)

    def meet(self, own: np.ndarray, others: np.ndarray, n: np.ndarray, words: np.ndarray) -> None:
        """Row own[i] meets row others[i] of the table n, words."""
        if not len(own):
            return
        self.n_near += np.bincount(own, minlength=len(self.n_near))
        best = np.zeros(len(self.n_near), np.int64)
        np.maximum.at(best, own, n[others])
        tied = np.flatnonzero(n[others] == best[own])
        order = tied[np.lexsort((words[others[tied]].astype(bytes), own[tied]))]
        first = order[np.flatnonzero(np.diff(own[order], prepend=-1))]
        for i, j in zip(own[first].tolist(), others[first].tolist(), strict=True):
            if n[j] > self.best_n[i] or (n[j] == self.best_n[i] and words[j] < self.best[i]):
                self.best_n[i], self.best[i] = n[j], words[j]

    def batch(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.n_near)
        text = lambda rows: pa.array([w.decode("latin-1") for w in rows], pa.string())
        return pa.RecordBatch.from_arrays([text(self.words[at]), pa.array(self.n_near[at]), pa.array(self.best_n[at]), text(self.best[at])], ["word", "n_near", "best_n", "best"])


class _Slice:
    """The words of one slice of a cell, in a tree."""

    def __init__(self, words: list[bytes], n: np.ndarray) -> None:
        self.words, self.n = np.array(words, object), n
        self.rows = letters(words)
        self.counts = letter_counts(self.rows)
        self.tree = Tree(self.counts)
        self.found = _Near(self.words)
        self.asked(self.words, self.rows, self.counts, n, False, self.found)

    def asked(self, words: np.ndarray, rows: np.ndarray, counts: np.ndarray, n: np.ndarray, longer: bool, found: _Near) -> None:
        own = found is self.found
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for at, members in self.tree.reached(counts, longer):
            i, j = one_edit(rows[at], self.rows[members], longer)
            i, j = at[i], members[j]
            if own:
                i, j = i[i < j], j[i < j]
            if len(i):
                hits.append((i, j))
        if hits:
            i, j = (np.concatenate(x) for x in zip(*hits, strict=True))
            found.meet(i, j, self.n, self.words)
            self.found.meet(j, i, n, words)


#: Queries that a task compares at once.
_ASKED_AT_ONCE = 4096


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of cell, slice and role: the points of a slice are kept, its queries pass by."""
    key, points, here = None, ([], []), None
    for batch in batches:
        if not len(batch):
            continue
        cell, part, role, n = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
        words = [w.encode("latin-1") for w in batch.column(3).to_pylist()]
        change = (np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(role) != 0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (cell[a], part[a]) != key:
                if key is not None:
                    here = here or _Slice(points[0], np.concatenate(points[1]))
                    yield here.found.batch()
                key, points, here = (cell[a], part[a]), ([], []), None
            if role[a] == POINT:
                points[0].extend(words[a:b])
                points[1].append(n[a:b])
                continue
            here = here or _Slice(points[0], np.concatenate(points[1]))
            for c in range(a, b, _ASKED_AT_ONCE):
                d = min(b, c + _ASKED_AT_ONCE)
                asking = np.array(words[c:d], object)
                rows = letters(words[c:d])
                found = _Near(asking)
                here.asked(asking, rows, letter_counts(rows), n[c:d], role[a] == SHORTER, found)
                yield found.batch()
    if key is not None:
        here = here or _Slice(points[0], np.concatenate(points[1]))
        yield here.found.batch()


def near_words(words: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """word, n_near, best_n and best (the most frequent near word; ties: the smallest) of the words (word, n) that have a near word.

    Words are distinct and hold letters a-z and from U+00C0 to U+00FF only.
    """
    total = words.count()
    # Words whose hash falls in a share: about rules.sampled of them, and no task sends more than its own.
    share = int(min(1.0, rules.sampled / max(total, 1)) * 2**30)
    sample = [r.word for r in words.select("word").where(F.pmod(F.xxhash64("word"), F.lit(2**30)) < share).limit(2 * rules.sampled).collect()]
    cells = Cells(sample, total, rules)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, part in _by_length(batch.column(0).to_pylist()):
                found, n = np.unique(cells.own(letter_counts(letters(part)), length), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["cell", "size"])

    # One row a cell; there are at most rules.most_cells of them, and one for each length that the sample lacks.
    sizes = words.select("word").mapInArrow(placed, "cell long, size long").groupBy("cell").agg(F.sum("size").alias("size")).collect()
    cells.slices = {r.cell: -(-r["size"] // rules.slice_words) for r in sizes}
    dealt = words.select("word", "n").mapInArrow(lambda batches: _dealt(cells, batches), _DEALT)
    parts = dealt.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "role").mapInArrow(_met, _PARTS)
    best = F.min(F.struct((-F.col("best_n")).alias("rest"), "best")).alias("b")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.rest")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the whole texts (doc_id, text).

    Words are runs of letters with A-Z lower-cased; by the hash of document and run some lose a letter first.
    Null and empty texts have no words; a null doc_id counts as an empty one in that hash; repeated rows count
    each. A run may be of any length. The form is the near word of largest n (ties: the smallest) that
    occurs often enough, else null; the root follows forms to the last. Each form occurs twice as often as its word
    at least, so chains are short and end. Empty tables give an empty table; further columns are left aside.
    """
    words = written(vocabulary(docs, rules), "words")
    near = written(near_words(words, rules), "near")
    chosen = F.col("best_n") >= rules.form_ratio * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n"))
    rows = written(rows, "forms")
    drop_all(words, near)
    links = written(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    # Each round follows twice as many forms as the one before.
    while not links.where("moved").isEmpty():
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, links = links, written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_all(old)
    return rows.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
