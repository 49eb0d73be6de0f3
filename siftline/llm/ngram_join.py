"""N-gram Jaccard join by chosen paths.

Texts with the same set of word shingles are one vertex. Each vertex has a min-hash embedding of
64 tokens. A run puts all vertices into buckets by one token; buckets over a limit are split
again on tokens sampled by their path, shared by all their members; small buckets, and those at
the depth limit, are compared by brute force. As many runs are made as the target recall takes.

Brute force goes over blocks of a bucket, so that no task holds a large bucket. First the
embeddings alone show which members have a partner, then the shingle sets of these are computed
from their whole texts and compared exactly. A pair counts in the first bucket that both share
and nowhere else. Blocks give numbers of links and the edges of a spanning forest, not all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.bpe import small_slices
from siftline.llm.common import Words, drop_written, split_hot, written

TOKENS = 64
_SEED = np.random.Generator(np.random.PCG64(11))
_XOR = _SEED.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _SEED.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Join:
    similarity: float = 0.8
    shingle: int = 5
    target_recall: float = 0.9999
    #: Buckets of more members are split, at most so many times, on so many sampled tokens each. One that
    #: holds over half of its parent holds near copies, which no split separates: it is compared as it is.
    bucket: int = 256
    depth: int = 3
    fan_out: int = 3
    #: Members of a block in brute force.
    block: int = 256

    def runs(self) -> int:
        """A pair at the threshold shares a run's first token with this probability, and one of the sampled tokens at each split."""
        one = self.similarity * (1 - (1 - self.similarity) ** self.fan_out) ** (self.depth - 1)
        return max(1, math.ceil(math.log(1 - self.target_recall) / math.log(1 - one)))

    def least_equal(self) -> int:
        """Equal tokens below which a pair at the threshold falls with a probability under 1e-7."""
        p, total = self.similarity, 0.0
        for k in range(TOKENS + 1):
            total += math.comb(TOKENS, k) * p**k * (1 - p) ** (TOKENS - k)
            if total > 1e-7:
                return k
        return 0


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; under k words, all its words are one shingle."""
    words = Words(texts)
    grams = words.grams(k)
    out = []
    for a, b in zip(words.bounds, words.bounds[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            short = words.hashes[a:b]
            out.append(np.array([int.from_bytes(hashlib.blake2b(short.tobytes(), digest_size=8).digest())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(grams: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 4096):
        np.minimum(out, ((grams[None, i : i + 4096] ^ _XOR[:, None]) * _TIMES[:, None]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def embedded(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, version, a 128-bit key of the shingle set (null without words), its size and its tokens."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in small_slices(batch, 2, 1 << 20):
                sets = shingle_sets([t or b"" for t in texts], k)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                tokens = np.stack([min_hashes(s) if len(s) else np.zeros(TOKENS, np.int32) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.size + 1, TOKENS, dtype=np.int32)), pa.array(tokens.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), lists], ["doc_id", "version", "key", "n", "tokens"])

    return rows.mapInArrow(sign, "doc_id long, version long, key binary, n int, tokens array<int>")


def buckets(vertices: DataFrame, how: Join) -> DataFrame:
    """path, vertex and members (of the bucket) for all buckets of two or more that are to be compared."""

    def counted(paths: DataFrame) -> DataFrame:
        sizes = paths.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
        return written(paths.join(sizes, "path"), "paths")

    too_large = (F.col("members") > how.bucket) & (2 * F.col("members") <= F.coalesce("parent", 2 * F.col("members")))
    token = lambda i: F.get(F.col("tokens"), i)
    first = F.array(*[F.xxhash64(F.lit(r), token(F.lit(r % TOKENS))) for r in range(how.runs())])
    level, done = counted(vertices.select("vertex", F.lit(None).cast("long").alias("parent"), F.explode(first).alias("path"))), None
    for depth in range(how.depth):
        over = too_large if depth + 1 < how.depth else F.lit(False)
        kept = level.where(~over)
        done = kept if done is None else done.unionByName(kept)
        if depth + 1 == how.depth or level.where(over).isEmpty():
            break

        def child(j: int) -> Column:
            at = F.pmod(F.xxhash64("path", F.lit(j)), F.lit(TOKENS)).cast("int")
            return F.xxhash64("path", at, token(at))

        split = level.where(over).join(vertices.select("vertex", "tokens"), "vertex")
        level = counted(split.select("vertex", F.col("members").alias("parent"), F.explode(F.array_distinct(F.array(*[child(j) for j in range(how.fan_out)]))).alias("path")))
    return done.drop("parent")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by their first columns, cut between groups, with the groups' bounds."""
    tail: pa.RecordBatch | None = None

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(max(len(batch) - 1, 0), bool)
        for i in range(keys):
            change |= np.diff(batch.column(i).to_numpy()) != 0
        return np.concatenate(([0], np.flatnonzero(change) + 1, [len(batch)]))

    for batch in batches:
        if not len(batch):
            continue
        if tail is not None and len(tail):
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        cuts = bounds(batch)
        if len(cuts) > 2:
            yield batch.slice(0, cuts[-2]), cuts[:-1]
        tail = batch.slice(cuts[-2])
    if tail is not None and len(tail):
        yield tail, np.array([0, len(tail)])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)


def _padded(values: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """Rows a to b of a list column as a matrix; the free places of a row hold values of its own."""
    sizes = offsets[a + 1 : b + 1] - offsets[a:b]
    out = np.arange(-2, -2 - (b - a), -1, dtype=np.int64)[:, None].repeat(int(sizes.max()), 1)
    for i in range(b - a):
        out[i, : sizes[i]] = values[offsets[a + i] : offsets[a + i + 1]]
    return out


def _first_shared(paths: np.ndarray, i: int, others: np.ndarray, path: int) -> np.ndarray:
    """Whether ``path`` is the first in row i's sorted list that each other row has as well."""
    own = paths[i]
    at = int(np.flatnonzero(own == path)[0])
    if at == 0:
        return np.ones(len(others), bool)
    return ~(paths[others][:, :, None] == own[None, None, :at]).any((1, 2))


def _candidates(i: int, low: np.ndarray, sizes: np.ndarray, side: np.ndarray, within: bool, similarity: float) -> np.ndarray:
    """Rows after i, of the other block unless it is one block, whose sizes allow the similarity."""
    ok = np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9
    ok &= (low > i) if within else (side != side[i])
    return np.flatnonzero(ok)


def active_members(members: DataFrame, how: Join) -> DataFrame:
    """Members of blocks that have a partner by the embeddings, in the first bucket that both share."""
    least = how.least_equal()

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in whole_groups(batches, 3):
            path, one, two, side, sizes = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 7))
            tokens, _ = _lists(batch.column("tokens"))
            start = np.asarray(batch.column("tokens").offsets)[0]
            tokens = tokens[start : start + TOKENS * len(batch)].reshape(-1, TOKENS)
            values, offsets = _lists(batch.column("paths"))
            keep = np.zeros(len(batch), bool)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                own, size, blocks, rows = tokens[a:b], sizes[a:b], side[a:b], np.arange(b - a)
                within, paths = one[a] == two[a], None
                for i in range(b - a):
                    near = _candidates(i, rows, size, blocks, within, how.similarity)
                    if not len(near) or (not within and blocks[i] != one[a]):
                        continue
                    near = near[(own[near] == own[i]).sum(1) >= least]
                    if len(near):
                        paths = _padded(values, offsets, a, b) if paths is None else paths
                        near = near[_first_shared(paths, i, near, path[a])]
                        keep[a + near] = True
                        keep[a + i] |= len(near) > 0
            if keep.any():
                yield batch.filter(pa.array(keep)).select(["path", "one", "two", "side", "vertex", "doc_id", "version", "n", "copies", "paths"])

    schema = "path long, one int, two int, side int, vertex long, doc_id long, version long, n int, copies long, paths array<long>"
    return members.mapInArrow(screen, schema)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i + 1, n):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    new = np.concatenate(([True], np.diff(values) != 0))
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, rows = column[often], rows[often]
    if len(column):
        column = np.cumsum(np.concatenate(([0], (np.diff(column) != 0).astype(np.int64))))
    out, width = np.zeros((n, n), np.float64), 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((n, width), np.float32)
        dense[rows[a:b], column[a:b] - lo] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def verified_links(active: DataFrame, how: Join) -> DataFrame:
    """(vertex, null, links) for each block's members, and (vertex, other, 0) for the edges of its spanning forest."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in whole_groups(batches, 3):
            path, one, two, side, vertex = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 4))
            copies = batch.column("copies").to_numpy()
            values, offsets = _lists(batch.column("paths"))
            texts = batch.column("text").cast(pa.binary())
            out: list[tuple[int, int | None, int]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                _, unique = np.unique(vertex[a:b], return_index=True)
                if len(unique) < 2:
                    continue
                at = a + unique
                sets = shingle_sets([t or b"" for t in texts.take(pa.array(at)).to_pylist()], how.shingle)
                sizes, blocks = np.array([len(s) for s in sets]), side[at]
                shared, paths, within = shared_counts(sets), _padded(values, offsets, a, b)[unique], one[a] == two[a]
                links, parent = np.zeros(len(at), np.int64), list(range(len(at)))

                def root(x: int, parent: list[int] = parent) -> int:
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for i in range(len(at)):
                    if not within and blocks[i] != one[a]:
                        continue
                    near = _candidates(i, np.arange(len(at)), sizes, blocks, within, how.similarity)
                    near = near[shared[i, near] >= how.similarity * (sizes[i] + sizes[near] - shared[i, near]) - 1e-9]
                    if len(near):
                        near = near[_first_shared(paths, i, near, path[a])]
                    links[i] += copies[at[near]].sum()
                    links[near] += copies[at[i]]
                    for j in near.tolist():
                        x, y = root(i), root(j)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                out += [(int(vertex[at[i]]), None, int(links[i])) for i in np.flatnonzero(links)]
                out += [(int(vertex[at[i]]), int(vertex[at[root(i)]]), 0) for i in range(len(at)) if root(i) != i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["vertex", "other", "links"])

    return active.mapInArrow(compare, "vertex long, other long, links long")


def components(edges: DataFrame) -> DataFrame:
    """vertex and root (the smallest vertex of its component) for every vertex of edges(a, b).

    Large and small stars in turn until the edges stay; every step is a join and an aggregation, and is written.
    """
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        near = near.join(least, "a")
        if large:
            moved = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            low = near.where(F.col("b") < F.col("a"))
            moved = low.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return written(moved.where(F.col("a") != F.col("b")).distinct(), "stars")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = state(now)
    while before[0]:
        large = star(now, True)
        small = star(large, False)
        drop_written(spark, now)
        drop_written(spark, large)
        now, after = small, state(small)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))


def jaccard_classes(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and n_links of every row of docs(doc_id, text).

    Words are lower-cased runs of letters, digits and non-ASCII characters; a text of one to four
    words is one shingle. Two texts are linked if the Jaccard similarity of their shingle sets
    reaches the threshold; n_links counts the other rows linked with a row, its copies included.
    Classes are the components of the links. Texts without words (null, empty) have no links and
    are classes of their own. Repeated rows link with each other; an empty table gives an empty table.
    """
    return _classes(docs, how).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame, how: Join) -> DataFrame:
    """The rows of jaccard_classes() with version, the hash of the text, and that of the row with the smallest doc_id and version of the class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    signed = written(embedded(rows, how.shingle), "embedded")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", "n", "tokens"))  # null ids last
    vertices = signed.where("key is not null").groupBy("key").agg(best.alias("best"), F.count("*").alias("copies"))
    # Numbers, not hashes, name the vertices: no two sets ever share one. The table is written, so they stay.
    vertices = written(vertices.select(F.monotonically_increasing_id().alias("vertex"), "key", "copies", "best.doc_id", "best.version", "best.n", "best.tokens"), "vertices")
    found = buckets(vertices, how)
    listed = found.groupBy("vertex").agg(F.array_sort(F.collect_set(F.struct("path", "members"))).alias("found"))
    members = listed.join(vertices, "vertex").withColumn("paths", F.transform("found", lambda x: x["path"])).select("*", F.explode("found").alias("bucket"))
    blocks = F.ceil(F.col("bucket.members") / F.lit(float(how.block))).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("vertex", F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    task = ["path", "one", "two"]
    members = (
        members.select(F.col("bucket.path").alias("path"), "side", other.alias("other"), "vertex", "doc_id", "version", "n", "copies", "tokens", "paths")
        .select("path", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "vertex", "doc_id", "version", "n", "copies", "tokens", "paths")
        .repartition(*task)
        .sortWithinPartitions(*task)
    )
    active = written(active_members(members, how), "active")
    # Groups without any id meet one row of their text.
    unnamed = rows.where("doc_id is null").dropDuplicates(["version"]).select("version", "text")
    texts = active.join(rows.dropDuplicates(["doc_id", "version"]), ["doc_id", "version"]).unionByName(active.where("doc_id is null").join(unnamed, "version"))
    texts = texts.select(*task, "side", "vertex", "copies", "paths", "text")
    links = written(verified_links(texts.repartition(*task).sortWithinPartitions(*task), how), "links")
    roots = components(links.where("other is not null").select(F.col("vertex").alias("a"), F.col("other").alias("b")))
    degree = links.where("other is null").groupBy("vertex").agg(F.sum("links").alias("links"))
    classed = vertices.select("vertex", "key", "copies", "doc_id", "version").join(roots, "vertex", "left").join(degree, "vertex", "left")
    classed = classed.withColumn("root", F.coalesce("root", "vertex"))
    smallest = classed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("least"))
    classed = classed.join(smallest, "root").select("key", "copies", F.col("least.doc_id").alias("class_id"), F.col("least.version").alias("class_version"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    members, classed = split_hot(signed.select("doc_id", "version", "key"), written(classed, "classes"), "key", "copies")
    return members.join(classed, ["key", "slice"], "left").select("doc_id", "version", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_version", "version").alias("class_version"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """One row of each class of docs: that with the smallest doc_id, and hash of its text. Texts without words and null ids stay."""
    first = (F.col("doc_id") == F.col("class_id")) & (F.col("version") == F.col("class_version"))
    rest = _classes(docs.where("doc_id is not null"), how).where(~first).select(F.col("doc_id").alias("__id"), F.col("version").alias("__other")).distinct()
    once = docs.withColumn("__version", F.xxhash64("text"))
    once = once.join(rest, (F.col("doc_id") == F.col("__id")) & (F.col("__version") == F.col("__other")), "left_anti")
    # Equal rows share their doc_id and version, so no text moves again for this.
    once = once.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "__version").orderBy("__version")))
    wordless = ~F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return once.where((F.col("__nth") == 1) | F.col("doc_id").isNull() | wordless).select(*docs.columns)
