"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. With c the centre of a cluster and b the largest angle between c
and a member, no member u has a larger inner product with a vector x than |u| |x| cos(max(0, angle(x, c) - b)).
So one list for each cluster, of all vectors by descending |x| cos(...), serves all its members: each
walks it until its answer is certain, that is until the bound of the rest is below what it still needs.

A list is kept as segments, cut where a histogram of the bounds says that enough vectors lie. The
first segments of each list give every member its first answer, and so what it needs; then only
segments whose bound reaches the need of some member are read. Positives are found first, negatives
after them, both by such a walk. Vectors are whole numbers, so scores are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import written
from siftline.llm.ngram_join import whole_groups


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 10
    #: A negative's score lies between these shares of the positive's, in hundredths.
    least_percent: int = 30
    most_percent: int = 90
    #: Factor of each component before it is cut to a whole number.
    scale: int = 256
    #: Clusters at most, anchors for each, and the anchors that the centres are sought on.
    most_clusters: int = 64
    members: int = 64
    clustered_on: int = 4096
    #: Vectors of a segment's slice, and anchors that meet one at a time.
    segment: int = 4096
    block: int = 512
    seed: int = 3


#: Bins of a list's bounds. A bin with very many vectors, such as copies of one, is cut into slices by id.
_BINS = 1024
#: Vectors with a longer norm take no part: two of them might have a score that no long holds.
LONGEST = float(2**31)


def _matrix(column: pa.ListArray) -> np.ndarray:
    values, offsets = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    return values[offsets[0] : offsets[-1]].reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows: in doubles where those hold all sums, else in longs."""
    norm = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0))
    if norm(a) * norm(b) < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v of the rows that take part: floor(scale * x) of each component x.

    Rows with a null id, label, vector or component, or with one that is not finite, take no part, nor do
    those of another length than the most frequent one (ties: the smaller) or of a norm from 2**31 on. Rows that
    repeat an id count once, with the smallest vector, and of these the smallest label.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.forall("embedding", finite))
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size("embedding") == (size["size"] if size else 0))
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.where(norm < LONGEST).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", F.col("r.label").cast("long").alias("label"), F.col("r.v").alias("v"))


class Lists:
    """The clusters' centres and angles, and from these the bound and bin of each vector in each list."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres, self.widest = centres, np.zeros(len(centres))
        self.edges = np.zeros((len(centres), _BINS))

    def angles(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms, and angles to each centre; a zero vector has angle 0."""
        x = x.astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        cosine = np.divide(x @ self.centres.T, norm[:, None], out=np.ones((len(x), len(self.centres))), where=norm[:, None] > 0)
        return norm, np.arccos(np.clip(cosine, -1, 1))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each row and list: no member u has a larger inner product than |u| times this; slack for rounding."""
        norm, angle = self.angles(x)
        return norm[:, None] * (np.cos(np.maximum(0, angle - self.widest)) + 1e-6)

    def bins(self, bounds: np.ndarray) -> np.ndarray:
        """Place in each list: bin 0 has the largest bounds. Bin b holds bounds up to top(b)."""
        low, high = self.edges[:, 0], self.edges[:, -1]
        step = np.where(high > low, (high - low) / _BINS, 1.0)
        return np.clip(np.floor((high - bounds) / step), 0, _BINS - 1).astype(np.int64)

    def tops(self) -> np.ndarray:
        """Largest bound that a vector of each list's bins can have."""
        low, high = self.edges[:, :1], self.edges[:, -1:]
        step = np.where(high > low, (high - low) / _BINS, 1.0)
        return high - step * np.arange(_BINS) + 1e-9 * np.abs(high)


def _centres(directions: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means; each centre has length 1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = directions[rng.choice(len(directions), k, replace=False)]
    for _ in range(12):
        nearest = (directions @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, directions)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def clustered(anchors: DataFrame, how: Mining) -> tuple[Lists, DataFrame]:
    """The lists, and the anchors (vec_id, label, v) with their cluster and norm. Centres come from a bounded sample of anchors."""
    n = anchors.count()
    sample = anchors.orderBy(F.xxhash64("vec_id", F.lit(how.seed)), "vec_id").limit(how.clustered_on).select("v").toArrow()
    x = _matrix(sample.column(0).combine_chunks()).astype(np.float64) if sample.num_rows else np.zeros((0, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    directions = np.unique(x[norm[:, 0] > 0] / norm[norm[:, 0] > 0], axis=0)
    dim = x.shape[1]
    k = min(how.most_clusters, -(-n // how.members), len(directions))
    lists = Lists(_centres(directions, k, how.seed) if k else np.eye(1, dim))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                size, angle = lists.angles(_matrix(batch.column(2)))
                own = angle.argmin(1)
                columns = [*batch.columns, pa.array(own), pa.array(size), pa.array(np.where(size > 0, angle[np.arange(len(own)), own], 0.0))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "cluster", "norm", "angle"])

    members = written(anchors.select("vec_id", "label", "v").mapInArrow(nearest, "vec_id long, label long, v array<long>, cluster long, norm double, angle double"), "anchors")
    for r in members.groupBy("cluster").agg(F.max("angle").alias("angle")).collect():  # most_clusters rows
        lists.widest[r.cluster] = r.angle
    return lists, members


def _filled(lists: Lists, rows: DataFrame, how: Mining) -> np.ndarray:
    """Vectors in each bin of each list; sets the lists' edges."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(len(lists.centres), np.inf), np.full(len(lists.centres), -np.inf)
        for batch in batches:
            if len(batch):
                b = lists.bounds(_matrix(batch.column(0)))
                low, high = np.minimum(low, b.min(0)), np.maximum(high, b.max(0))
        at = np.flatnonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(low[at]), pa.array(high[at])], ["cluster", "low", "high"])

    for r in rows.select("v").mapInArrow(edges, "cluster long, low double, high double").groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        lists.edges[r.cluster] = np.linspace(r.low, r.high, _BINS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(lists.centres), _BINS), np.int64)
        for batch in batches:
            if len(batch):
                at = lists.bins(lists.bounds(_matrix(batch.column(0)))) + np.arange(len(n)) * _BINS
                n += np.bincount(at.ravel(), minlength=n.size).reshape(n.shape)
        at = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["bin", "n"])

    out = np.zeros((len(lists.centres), _BINS), np.int64)
    for r in rows.select("v").mapInArrow(fill, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # clusters * _BINS rows at most
        out.ravel()[r.bin] = r.n
    return out


class Segments:
    """A list's bins joined into segments of about so many vectors; a bin that is larger has slices."""

    def __init__(self, lists: Lists, filled: np.ndarray, how: Mining) -> None:
        before = np.cumsum(filled, axis=1) - filled
        #: Number of the segment of each bin, from 0.
        self.of = before // how.segment
        self.count = int(self.of.max(initial=0)) + 1
        clusters = len(filled)
        self.rows = np.zeros((clusters, self.count), np.int64)
        self.top = np.full((clusters, self.count), -np.inf)
        for c in range(clusters):
            np.add.at(self.rows[c], self.of[c], filled[c])
            np.maximum.at(self.top[c], self.of[c], np.where(filled[c] > 0, lists.tops()[c], -np.inf))
        #: Slices of each segment; the vectors of a segment are shared out over them by id.
        self.slices = np.maximum(1, -(-self.rows // how.segment))


def _lexsorted(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


_ITEM = "cluster long, segment long, slice long, block long, role int, vec_id long, label long, bound double, v array<long>, asked array<struct<positive_id: long, low: long, high: long, need: long>>"
_HIT = "anchor_id long, positive_id long, vec_id long, score long"


def _walked(k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members of a group walk its part of the list. Rows are in order of group, role (members first), then descending bound.

    Each question of a member asks for the k best scores between low and high among vectors of its own label, or
    of the others, and needs none below ``need``.
    """

    def answers_of(found: list, members: list[tuple]) -> list[tuple]:
        return [(m[0], q["positive_id"], *kept) for m, lists in zip(members, found, strict=True) for q, kept in zip(m[2], lists, strict=True) if kept]

    def group(members: list[tuple], norms: np.ndarray, u: np.ndarray, part: pa.RecordBatch) -> list[tuple]:
        ids, labels = part.column(5).to_numpy(), part.column(6).to_numpy()
        bounds, x = part.column(7).to_numpy(), _matrix(part.column(8))
        found: list[list[list[np.ndarray]]] = [[[] for _ in m[2]] for m in members]
        need = [[q["need"] for q in m[2]] for m in members]
        active = np.arange(len(members))
        for a in range(0, len(ids), 512):
            b = min(a + 512, len(ids))
            # Certified: what follows cannot reach what any question of the member still needs.
            active = active[[norms[i] * bounds[a] >= min(need[i]) for i in active]]
            if not len(active):
                return answers_of(found, members)
            scores = _products(u[active], x[a:b])
            for row, i in zip(scores, active.tolist(), strict=True):
                own, label, asked = members[i]
                fits = ((labels[a:b] == label) == same) & (ids[a:b] != own)
                for j, q in enumerate(asked):
                    at = np.flatnonzero(fits & (row >= max(q["low"], need[i][j])) & (row <= q["high"]))
                    if len(at):
                        kept = found[i][j]
                        ids_, scores_ = ids[a:b][at], row[at]
                        if kept:
                            ids_, scores_ = np.concatenate((kept[0], ids_)), np.concatenate((kept[1], scores_))
                        best = _lexsorted(scores_, ids_, k)
                        found[i][j] = [ids_[best], scores_[best]]
                        if len(best) == k:
                            need[i][j] = max(need[i][j], int(scores_[best[-1]]))
        return answers_of(found, members)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in whole_groups(batches, 4):
            role = batch.column(4).to_numpy()
            for a, b in zip(cuts, cuts[1:], strict=False):
                m = a + int(np.searchsorted(role[a:b], 1))
                if m == a or m == b:
                    continue
                head = batch.slice(a, m - a)
                members = list(zip(head.column(5).to_pylist(), head.column(6).to_pylist(), head.column(9).to_pylist(), strict=True))
                u = _matrix(head.column(8))
                answers = group(members, np.sqrt((u.astype(np.float64) ** 2).sum(1)), u, batch.slice(m, b - m))
                if answers:
                    n = [len(x[2]) for x in answers]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in answers], n)), pa.array(np.repeat([x[1] for x in answers], n)), pa.array(np.concatenate([x[2] for x in answers])), pa.array(np.concatenate([x[3] for x in answers]))], ["anchor_id", "positive_id", "vec_id", "score"])

    return walk


def _read(lists: Lists, segments: Segments, wanted: np.ndarray, asking: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, positive_id, vec_id and score: the best of each part of the lists that is read.

    ``asking``: cluster, segment, block, vec_id, label, v and asked of the members for each segment that they read.
    ``wanted``: blocks of members that read each segment of each list.
    """
    item = [x.split()[0] for x in _ITEM.split("asked")[0].split(", ") if x] + ["asked"]
    slices = F.array(*[F.array(*[F.lit(int(n)) for n in row]) for row in segments.slices]) if segments.slices.size <= 4096 else None
    if slices is None:
        table = asking.sparkSession.createDataFrame([(c, s, int(n)) for c, row in enumerate(segments.slices) for s, n in enumerate(row)], "cluster long, segment long, slices int")
        sliced = asking.join(table, ["cluster", "segment"])
    else:
        sliced = asking.withColumn("slices", slices[F.col("cluster").cast("int")][F.col("segment").cast("int")])
    members = sliced.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)))
    members = members.select("cluster", "segment", "slice", "block", F.lit(0).alias("role"), "vec_id", "label", F.lit(0.0).alias("bound"), "v", "asked")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters = np.arange(len(lists.centres))
        for whole in batches:
            for a in range(0, len(whole), 1024):
                batch = whole.slice(a, 1024)
                bound = lists.bounds(_matrix(batch.column(2)))
                segment = segments.of[clusters, lists.bins(bound)]
                row, cluster = np.nonzero(wanted[clusters, segment] > 0)
                if not len(row):
                    continue
                # Once for each block of members that reads the segment.
                copies = wanted[cluster, segment[row, cluster]]
                block = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
                row, cluster = np.repeat(row, copies), np.repeat(cluster, copies)
                own, ids = segment[row, cluster], batch.column(0).to_numpy()[row]
                part = (ids * np.int64(0x9E3779B1) >> 7) % segments.slices[cluster, own]
                at = pa.array(row)
                nothing = pa.nulls(len(row), pa.list_(pa.struct([("positive_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("need", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(own), pa.array(part), pa.array(block), pa.array(np.ones(len(row), np.int32)), *(batch.column(i).take(at) for i in (0, 1)), pa.array(bound[row, cluster]), batch.column(2).take(at), nothing], item)

    met = members.unionByName(rows.select("vec_id", "label", "v").mapInArrow(placed, _ITEM))
    keys = ["cluster", "segment", "slice", "block"]
    return met.repartition(*keys).sortWithinPartitions(*keys, "role", F.desc("bound"), "vec_id").mapInArrow(_walked(k, same), _HIT)


def _first(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


#: First segments of each list that all members read.
_HEAD = 1


def _walks(lists: Lists, segments: Segments, members: DataFrame, rows: DataFrame, k: int, same: bool, how: Mining) -> DataFrame:
    """The k first answers of each question of the members (cluster, block, vec_id, label, v, norm, asked).

    First all members read the head of their list; then each reads the segments whose bound reaches what it still needs.
    """
    blocks = np.zeros(len(lists.centres), np.int64)
    for r in members.groupBy("cluster").agg((F.max("block") + 1).alias("n")).collect():
        blocks[r.cluster] = r.n
    spark = rows.sparkSession
    columns = ["cluster", "segment", "block", "vec_id", "label", "v", "asked"]
    head = np.zeros((len(blocks), segments.count), np.int64)
    head[:, :_HEAD] = blocks[:, None]
    asking = members.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_HEAD - 1).cast("long")))).select(columns)
    first = written(_first(_read(lists, segments, head, asking, rows, k, same), k), "first")
    if segments.count <= _HEAD:
        return first
    # What a question still needs: its last answer's score if it has all k, else the lowest score that it takes.
    got = first.groupBy("anchor_id", "positive_id").agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") == k)
    asked = members.select("vec_id", F.explode("asked").alias("q")).join(got, (F.col("vec_id") == F.col("anchor_id")) & (F.col("q.positive_id") == F.col("positive_id")), "left")
    need = F.greatest("q.need", F.coalesce("last", F.col("q.need")))
    later = asked.groupBy("vec_id").agg(F.collect_list(F.struct(F.col("q.positive_id").alias("positive_id"), F.col("q.low").alias("low"), F.col("q.high").alias("high"), need.alias("need"))).alias("asked"), F.min(need).alias("need"))
    tops = spark.createDataFrame([(c, s, float(segments.top[c, s])) for c in range(len(blocks)) for s in range(_HEAD, segments.count) if segments.rows[c, s]], "cluster long, segment long, top double")
    again = members.drop("asked").join(later, "vec_id").join(tops, "cluster").where(F.col("norm") * F.col("top") >= F.col("need"))
    again = written(again.select(columns), "again")
    wanted = np.zeros((len(blocks), segments.count), np.int64)
    for r in again.groupBy("cluster", "segment").agg((F.max("block") + 1).alias("n")).collect():  # clusters * _BINS rows at most
        wanted[r.cluster, r.segment] = r.n
    if not wanted.any():
        return first
    rest = _read(lists, segments, wanted, again, rows, k, same)
    return _first(first.drop("rank").unionByName(rest), k)


def mine(vectors: DataFrame, anchors: DataFrame, how: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Both tables have vec_id, label and v as whole_vectors() gives them; anchors are among the vectors. Of each anchor
    the first vectors of its own label are its positives, and of each positive the first vectors of other labels
    whose score lies between two shares of the positive's are its negatives; higher scores come first, ties by
    smaller vec_id. An anchor without positives, or a positive without negatives (so one with a negative score),
    has no rows. Zero vectors take part with score 0. Empty tables, and tables without anchors, give an empty table.
    """
    if anchors.isEmpty():
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    lists, members = clustered(anchors, how)
    block = F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("cluster")) / how.block))).cast("long")
    members = written(members.withColumn("block", block), "members")
    segments = Segments(lists, _filled(lists, vectors, how), how)
    lowest, highest = -(2**63), 2**63 - 1
    ask = lambda *q: F.struct(*[c.cast("long").alias(n) for n, c in zip(("positive_id", "low", "high", "need"), q, strict=True)])
    seeking = members.withColumn("asked", F.array(ask(F.col("vec_id"), F.lit(lowest), F.lit(highest), F.lit(lowest))))
    positives = _walks(lists, segments, seeking, vectors, how.positives, True, how)
    positives = written(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Shares in whole numbers: ceil(least * p / 100) and floor(most * p / 100); a positive with a negative score has no room between them.
    p = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(p * how.least_percent / 100).cast("long"), F.floor(p * how.most_percent / 100).cast("long")
    asked = positives.where(low <= high).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(ask(F.col("positive_id"), low, high, low)).alias("asked"))
    found = _walks(lists, segments, members.join(asked, "vec_id"), vectors, how.negatives, False, how)
    out = written(found, "negatives").join(positives, ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, anchor_modulus: int = 100, noise_modulus: int = 7, labels: int = 10, how: Mining = Mining()) -> DataFrame:
    """mine() over vectors (vec_id, embedding, label), where ids divisible by one number are anchors and those divisible by another
    have the next label (of so many). Rows that take no part: see whole_vectors(). Further columns are left aside."""
    noisy = F.when(F.col("vec_id") % noise_modulus == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = written(whole_vectors(vectors.withColumn("label", noisy), how.scale), "vectors")
    return mine(rows, rows.where(F.col("vec_id") % anchor_modulus == 0), how)
