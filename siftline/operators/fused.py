"""First rows of keyword and vector scores together, from dense blocks of questions and chunks.

A chunk becomes one row with its words and its sparse hash vector, in the task that reads it. Blocks of questions and of chunks meet in one group
each, where all their scores are computed as matrices; a group gives only its best rows of each question and the counts of all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.functions.words import splitter
from siftline.sources.scratch import written

#: Questions of one block, chunks of one block at most and of one matrix.
ASKED, CHUNKS, SLICE = 256, 32_768, 1024
DIM = 256


def _tools() -> tuple[Callable, Callable]:
    """Helpers of the tasks; nested, since workers need not have this module."""

    def lists(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
        """One list a row from values with the (ascending) numbers of their rows."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32()), values)

    def flat(column: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The values of all lists of a column, and the number of each value's row."""
        whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        lengths = pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False)
        return whole.flatten(), np.repeat(np.arange(len(whole)), lengths)

    return lists, flat


def features(rows: DataFrame) -> DataFrame:
    """rows with len, words and tf, and the normalized hash vector idx and value (as corpus.hash_embed()) in place of text."""
    kept = [c for c in rows.columns if c != "text"]
    lists, flat_of = _tools()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            flat, row = flat_of(batch.column("tokens"))
            coded = flat.dictionary_encode()
            names = coded.dictionary.to_pylist()
            digests = [hashlib.sha256(t.encode()).digest() for t in names]
            index, sign = np.array([d[3] for d in digests], np.int64), np.array([1 if d[4] % 2 == 0 else -1 for d in digests], np.int64)
            pair, tf = np.unique(row * max(len(names), 1) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            at, code = np.divmod(pair, max(len(names), 1))
            place, inverse = np.unique(at * DIM + index[code], return_inverse=True)
            v = np.bincount(inverse, weights=(sign[code] * tf).astype(np.float64), minlength=len(place))
            place, v = place[v != 0], v[v != 0]
            of, idx = np.divmod(place, DIM)
            norm = np.sqrt(np.bincount(of, weights=v * v, minlength=n))
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(np.bincount(row, minlength=n), pa.int32()), lists(coded.dictionary.take(pa.array(code, pa.int64())), at, n), lists(pa.array(tf, pa.int32()), at, n)]
            columns += [lists(pa.array(idx, pa.int32()), of, n), lists(pa.array(v / norm[of], pa.float64()), of, n)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "len", "words", "tf", "idx", "value"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", len int, words array<string>, tf array<int>, idx array<int>, value array<double>"
    return rows.select(*kept, F.coalesce(tx.tokenize(F.col("text")), F.array().cast("array<string>")).alias("tokens")).mapInArrow(run, schema)


def question_rows(terms: DataFrame, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, tokens and w (times asked and idf over the chunks), idx and value."""
    found = chunks.select(F.explode("words").alias("token")).join(F.broadcast(terms.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("df"))
    weighed = terms.join(found, "token").crossJoin(F.broadcast(chunks.agg(F.count("*").alias("n"))))  # one row
    w = F.col("qf") * F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("token", w.alias("w")))).alias("l"))
    words = words.select("query_id", F.transform("l", lambda x: x["token"]).alias("tokens"), F.transform("l", lambda x: x["w"]).alias("w"))
    return words.join(vectors, "query_id", "full_outer")


def first_rows(asked: DataFrame, chunks: DataFrame, weights: tuple[float, float], per_question: int, most: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The ``most`` best rows of each question and block of chunks (query_id, chunk_id, doc_id, score), and a row of counts of each question and block.

    ``asked``: question_rows(), of which query_id // per_question is the question; ``chunks``: features() with chunk_id, doc_id, boost and head (a
    chunk counts for the deduplicated ones). Counts are keyword_hits, vector_hits, scored and deduped; their rows have no chunk_id.
    """
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    stats = chunks.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).first()
    mean, n = max(stats.avg_len or 0.0, 1.0), stats.n
    nv = max(1, -(-n // CHUNKS), min(4 * cores, -(-n // SLICE)))
    one = F.floor(F.col("query_id") / per_question).cast("long")
    nq = max(1, -(-asked.select(one).distinct().count() // ASKED))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = asked.select(one.alias("one"), "tokens", "w", F.col("idx").alias("q_idx"), F.col("value").alias("q_value")).withColumn("a", F.pmod(F.xxhash64("one"), F.lit(nq))).withColumn("b", every(nv))
    right = chunks.where("boost IS NOT NULL").select("chunk_id", "doc_id", "boost", "head", "len", "words", "tf", "idx", "value", F.pmod(F.xxhash64("chunk_id"), F.lit(nv)).alias("b")).withColumn("a", every(nq))
    names = ["query_id", "chunk_id", "doc_id", "score", "keyword_hits", "vector_hits", "scored", "deduped"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    _, flat_of = _tools()

    def places(x: np.ndarray) -> np.ndarray:
        """Nine decimals, halves away from zero."""
        return np.floor(x * 1e9 + 0.5) / 1e9

    def dense(idx: pa.ChunkedArray, value: pa.ChunkedArray, count: int) -> np.ndarray:
        out = np.zeros((count, DIM))
        at, row = flat_of(idx)
        out[row, at.to_numpy(zero_copy_only=False)] = flat_of(value)[0].to_numpy(zero_copy_only=False)
        return out

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        q, c = q.sort_by("one"), c.sort_by("chunk_id")
        ids, starts = np.unique(q["one"].to_numpy(), return_index=True)
        flat, row = flat_of(q["tokens"])
        known = flat.unique()
        weight = np.zeros((len(q), max(len(known), 1)))
        weight[row, pc.index_in(flat, value_set=known).to_numpy(zero_copy_only=False)] = flat_of(q["w"])[0].to_numpy(zero_copy_only=False)
        x = dense(q["q_idx"], q["q_value"], len(q))
        boost, head = c["boost"].to_numpy(), pc.fill_null(c["head"], False).to_numpy()
        score, counts = np.full((len(ids), len(c)), -np.inf), np.zeros((4, len(ids)), np.int64)
        for begin in range(0, len(c), SLICE):
            part = c.slice(begin, SLICE)
            size = len(part)
            words, at = flat_of(part["words"])
            code = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            met = code >= 0
            tf, length = flat_of(part["tf"])[0].to_numpy(zero_copy_only=False)[met].astype(np.float64), part["len"].to_numpy().astype(np.float64)
            post = np.zeros((weight.shape[1], size))
            post[code[met], at[met]] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at[met]] / mean))
            y = dense(part["idx"], part["value"], size)
            raw = weight @ post
            shared = (raw > 0) | (((x != 0).astype(np.float32) @ (y != 0).T.astype(np.float32)) > 0)
            keyword = np.maximum.reduceat(places(raw), starts, axis=0)
            vector = np.maximum.reduceat(places(np.maximum(x @ y.T, 0)), starts, axis=0)
            shared = np.logical_or.reduceat(shared, starts, axis=0)
            here = slice(begin, begin + size)
            total = places(places(weights[0] * (keyword / (keyword + 1)) + weights[1] * vector) * boost[here][None, :])
            score[:, here] = np.where(shared, total, -np.inf)
            counts += np.stack([(keyword > 0).sum(1), (vector > 0).sum(1), shared.sum(1), (shared & head[here][None, :]).sum(1)])
        chosen_q, chosen_c = [], []
        for i in range(len(ids)):
            line = score[i]
            least = -np.inf if len(line) <= most else np.partition(line, len(line) - most)[len(line) - most]
            place = np.flatnonzero((line >= least) & (line > -np.inf))  # in the order of chunk_id, which decides ties
            place = place[np.argsort(-line[place], kind="stable")[:most]]
            chosen_q.append(np.full(len(place), i))
            chosen_c.append(place)
        i, j = np.concatenate(chosen_q), np.concatenate(chosen_c)
        best = [pa.array(ids[i]), c["chunk_id"].take(pa.array(j)).combine_chunks(), c["doc_id"].take(pa.array(j)).combine_chunks(), pa.array(score[i, j]), *[pa.nulls(len(i), pa.int64())] * 4]
        summed = [pa.array(ids), *[pa.nulls(len(ids), t) for t in kinds[1:4]], *[pa.array(x) for x in counts]]
        tables = [pa.Table.from_arrays(columns, names).cast(pa.schema(list(zip(names, kinds, strict=True)))) for columns in (best, summed)]
        return pa.concat_tables(tables)

    schema = "query_id long, chunk_id string, doc_id long, score double, keyword_hits long, vector_hits long, scored long, deduped long"
    return written(left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(compare, schema), "first_rows")


#: Texts that are cut at a time, and digests of words that a task remembers.
TEXTS, KNOWN = 2048, 1_000_000


def counted_vectors(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """rows with len, words (places in ``wanted``) and tf, and vector in place of text, all made where the text is read.

    Of the words only wanted ones stay. vector has the signed counts of the hash vector (as corpus.hash_embed(), not normalized), one byte
    for each component if they all fit, else four. A null text has no len, as in the SQL.
    """
    kept = [c for c in rows.columns if c != "text"]
    lists, flat_of = _tools()
    split, step, most, dim = splitter(tx.STOPWORDS), TEXTS, KNOWN, DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value_set = {}, pa.array(wanted, pa.string())
        for whole in batches:
            for begin in range(0, len(whole), step):
                batch = whole.slice(begin, step)
                n, texts = len(batch), batch.column("text")
                flat, row = flat_of(split(texts))
                coded = flat.dictionary_encode()
                names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                if len(known) > most:
                    known.clear()
                for t in names:
                    if t not in known:
                        d = hashlib.sha256(t.encode()).digest()
                        known[t] = d[3] if d[4] % 2 == 0 else ~d[3]
                hashed = np.fromiter((known[t] for t in names), np.int64, len(names))
                index, sign = np.where(hashed < 0, ~hashed, hashed), np.where(hashed < 0, -1.0, 1.0)
                v = np.bincount(row * dim + index[code], weights=sign[code], minlength=n * dim).reshape(n, dim).astype("<i4")
                if np.abs(v).max(initial=0) < 128:
                    vector = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * dim), pa.py_buffer(v.astype(np.int8).tobytes())])
                else:
                    vector = pa.array([(x.astype(np.int8) if np.abs(x).max() < 128 else x).tobytes() for x in v], pa.binary())
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=value_set), -1).to_numpy(zero_copy_only=False)[code].astype(np.int64)
                met = place >= 0
                pair, tf = np.unique(row[met] * max(len(wanted), 1) + place[met], return_counts=True)
                at, word = np.divmod(pair, max(len(wanted), 1))
                length = pa.array(np.bincount(row, minlength=n), pa.int32(), mask=texts.is_null().to_numpy(zero_copy_only=False))
                columns = [length, lists(pa.array(word, pa.int32()), at, n), lists(pa.array(tf, pa.int32()), at, n), vector]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "len", "words", "tf", "vector"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", len int, words array<int>, tf array<int>, vector binary"
    return rows.select(*kept, "text").mapInArrow(run, schema)


def profile_tops(terms: DataFrame, queries: DataFrame, chunks: DataFrame, boosts: DataFrame | None, most: dict[str, int], weights: tuple[float, float] = (0.62, 0.38), k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """profile, query_id, rank, chunk_id and score: the first rows of the profiles keyword, semantic and hybrid, as many as ``most`` says, in one pass over the texts.

    ``terms``: query_id, token and qf; ``queries``: query_id and question; ``chunks``: chunk_id and text; ``boosts``: chunk_id and boost. A text becomes a
    row of a few hundred bytes where it is read. Each batch of these rows meets all questions of a block in matrices and gives only its first rows of each
    question, so that nothing grows with the pairs. Questions go to the tasks in blocks, one after the other.
    """
    told = sorted((r.query_id, r.token, r.qf) for r in terms.select("query_id", "token", "qf").collect())
    wanted = sorted({t for _, t, _ in told})
    code = {t: i for i, t in enumerate(wanted)}
    rows = written(counted_vectors(chunks.select("chunk_id", "text"), wanted), "vectors")
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).first()
    mean, df = max(stats.avg_len or 0.0, 1.0), {r.word: r.df for r in rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}
    idf = {w: float(np.log(1 + (stats.n - x + 0.5) / (x + 0.5))) for w, x in df.items()}
    vectors = {r.query_id: np.frombuffer(r.vector, np.int8 if len(r.vector) == DIM else "<i4").astype(np.float64) for r in counted_vectors(queries.select("query_id", F.col("question").alias("text")), []).select("query_id", "vector").collect()}
    placed = rows.join(boosts.select("chunk_id", F.col("boost").cast("double").alias("boost")), "chunk_id", "left").na.fill(1.0, ["boost"]) if boosts is not None else rows.withColumn("boost", F.lit(1.0))
    ids, kind, found = sorted(vectors), dict(queries.dtypes)["query_id"], None
    for begin in range(0, max(len(ids), 1), ASKED):
        block = ids[begin : begin + ASKED]
        at = {q: i for i, q in enumerate(block)}
        own = [(at[q], code[t], qf * idf[code[t]]) for q, t, qf in told if q in at and code[t] in idf]
        x = np.array([vectors[q] for q in block]).reshape(len(block), DIM)
        run = _compared(block, own, len(wanted), x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300), most, weights, k1, b, mean)
        one = placed.select("chunk_id", "len", "words", "tf", "vector", "boost").mapInArrow(run, f"profile string, query_id {kind}, chunk_id string, score double")
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("profile", "query_id").orderBy(F.desc("score"), "chunk_id"))
    last = F.create_map(*[F.lit(v) for pair in most.items() for v in pair])[F.col("profile")]
    return found.withColumn("rank", rank).where(F.col("rank") <= last).select("profile", "query_id", "rank", "chunk_id", "score")


def _compared(block: list, own: list[tuple[int, int, float]], n_words: int, x: np.ndarray, most: dict[str, int], weights: tuple[float, float], k1: float, b: float, mean: float) -> Callable:
    """A function of the tasks: the first rows of each question and batch. ``own``: place of a question, of a word, and its weight; x: the questions' vectors."""
    _, flat_of = _tools()
    step, dim = SLICE, DIM
    words = np.unique(np.array([w for _, w, _ in own], np.int64))
    column = np.full(max(n_words, 1), -1)
    column[words] = np.arange(len(words))

    def places(v: np.ndarray) -> np.ndarray:
        """Nine decimals, halves away from zero."""
        return np.floor(v * 1e9 + 0.5) / 1e9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros((len(block), max(len(words), 1)))
        for i, w, value in own:
            weight[i, column[w]] = value
        has = (x != 0).astype(np.float32)
        for batch in batches:
            if not len(batch) or not len(block):
                continue
            c = pa.Table.from_batches([batch]).sort_by("chunk_id")  # its order decides ties
            score = {name: np.full((len(block), len(c)), -np.inf) for name in most}
            for begin in range(0, len(c), step):
                part = c.slice(begin, step)
                size, boost = len(part), part["boost"].to_numpy()
                flat, at = flat_of(part["words"])
                code = column[flat.to_numpy(zero_copy_only=False).astype(np.int64)]
                met = code >= 0
                tf, length = flat_of(part["tf"])[0].to_numpy(zero_copy_only=False)[met].astype(np.float64), pc.fill_null(part["len"], 0).to_numpy().astype(np.float64)
                post = np.zeros((weight.shape[1], size))
                post[code[met], at[met]] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at[met]] / mean))
                y = np.array([np.frombuffer(v, np.int8 if len(v) == dim else "<i4") for v in part["vector"].to_pylist()], np.float64).reshape(size, dim)
                y /= np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-300)
                raw = weight @ post
                named, near = raw > 0, (has @ (y != 0).T.astype(np.float32)) > 0
                raw = places(raw)
                raw /= raw + 1
                cosine = places(np.maximum(x @ y.T, 0))
                values = {"keyword": (places(raw), named), "semantic": (cosine, near), "hybrid": (places(weights[0] * raw + weights[1] * cosine), named | near)}
                for name, line in score.items():
                    value, shared = values[name]
                    line[:, begin : begin + size] = np.where(shared, places(value * boost[None, :]), -np.inf)
            for name, lines in score.items():
                k = most[name]
                least = np.partition(lines, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(block), -np.inf)
                chosen = []
                for i, line in enumerate(lines):
                    place = np.flatnonzero((line >= least[i]) & (line > -np.inf))
                    chosen.append(place[np.argsort(-line[place], kind="stable")[:k]])
                i, j = np.repeat(np.arange(len(block)), [len(p) for p in chosen]), np.concatenate(chosen)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array([block[q] for q in i]), c["chunk_id"].take(pa.array(j)).combine_chunks(), pa.array(lines[i, j])], ["profile", "query_id", "chunk_id", "score"])

    return run
