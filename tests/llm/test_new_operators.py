"""The classifier, hard negatives and spelling variants: brute force, held-out labels, awkward rows."""

import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from siftline.llm import classifier, hard_negatives, queries, spelling

CLASH = "doc_id long, text string, lang string, source string, score double, word string, vec_id string"
AWKWARD = [
    (1, None, None, None, 0.5, "x", "x"), (2, "", "en", "a", 0.5, "x", None), (3, " \n\t", "en", "a", 0.5, "x", None), (None, "letters letters letters letter", None, None, None, None, None),
    (None, "letters letters letters letter", None, None, None, None, None), (5, "Ünïcode ÷×÷×÷ 漢字 Straße " * 3, "de", "b", 1.0, "x", None), (6, "a" * 70_000 + " " + "word " * 20_000, "en", "b", 1.0, "x", None), (6, "same id, other text", "en", "b", 1.0, "x", None),
]


# --- 11 ---


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op11_classifier(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert len(got) == len(docs)
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.quality, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_classifier_learns_from_other_folds_only(spark):
    docs = spark.createDataFrame([(i, f"{'good words here ' if i % 2 else '### $$$ !!! '}" * (5 + i % 7)) for i in range(200)], "doc_id long, text string")
    true = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    # Labels of the held-out fold are turned round; they must not matter.
    turned = true.withColumn("quality", F.when(classifier.held_out(F.col("doc_id"), 5), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = ({r.doc_id: r.score for r in classifier.classify(docs, x).collect()} for x in (true, turned))
    assert first == second and all((s >= 0.3) == bool(i % 2) for i, s in first.items())


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 5)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    how = classifier.Boosting(trees=25, depth=3)
    model = classifier.fitted(x, y, how)
    for row, score in zip(x[:100], model.scores(x[:100]), strict=True):
        total = model.start
        for t in range(how.trees):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.limit[t, node] else 1)
            total += model.value[t, node - 7]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((model.scores(x) > 0.5) == (y > 0)).mean() > 0.97


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = (x[:, 2] > 6).astype(float)
    y[:20] = 1 - y[:20]
    model = classifier.fitted(x, y, classifier.Boosting(trees=1, depth=1))
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max(((gain(x[:, j] <= v), j, v) for j in range(4) for v in range(11) if (x[:, j] <= v).any() and (x[:, j] > v).any()), key=lambda z: z[0])
    assert model.feature[0, 0] == best[1] and int(model.limit[0, 0]) == best[2]


def test_statistics_of_a_text():
    names = classifier.FEATURES
    got = dict(zip(names, classifier.statistics("One TWO 33 four*\none TWO 33 four*".encode()), strict=True))
    assert len(set(names)) == len(names) and got["words_per_line"] == 4 and got["odd_ends"] == 0.25 and got["upper_words"] == 0.25 and got["digit_words"] == 0.25
    assert got["repeated_words"] == 0.75 and abs(got["log_words"] - np.log(9)) < 1e-12 and got["distinct_words"] == 5 / 8 and got["duplicate_lines"] == 0


def test_classifier_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, CLASH)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 0, "x"), (2, 1, 0, "x"), (6, 0, 0, "x"), (None, 1, 0, "x"), (3, None, 0, "x"), (5, 7, 0, "x")], "doc_id long, quality int, toxic int, text string")
    for given in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = classifier.classify(docs, given).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows) and all(r.held_out for r in rows if r.doc_id is None)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert classifier.classify(docs.limit(0), labels).count() == 0
    assert "kept" in classifier.scored(docs.withColumn("kept", F.lit(1)), classifier.fitted(np.zeros((0, len(classifier.FEATURES))), np.zeros(0)), "score").columns
    bounded = classifier.learned(docs, labels, replace(classifier.Boosting(), fitted_on=2))
    assert len(bounded.feature) == 120


# --- 12 ---


def mined(rows, how=hard_negatives.Mining(), modulus=100):
    """Brute force over (vec_id, label, v)."""
    out = set()
    for a, label, v in rows:
        if a % modulus:
            continue
        near = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, k == label) for i, k, w in rows if i != a)
        for ps, p, _ in [x for x in near if x[2]][: how.positives]:
            fits = [x for x in near if not x[2] and how.least_percent * -ps <= 100 * -x[0] <= how.most_percent * -ps]
            out |= {(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(fits[: how.negatives])}
    return out


@pytest.mark.parametrize("how", [hard_negatives.Mining(), hard_negatives.Mining(members=2, segment=16, block=3), hard_negatives.Mining(positives=3, negatives=2, members=1, segment=5)])
def test_hard_negatives_against_brute_force(spark, how):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * 40
    vectors = np.concatenate([centres[rng.integers(0, 6, 380)] + rng.normal(size=(380, 8)) * 20, np.zeros((5, 8)), np.repeat(rng.normal(size=(1, 8)) * 30, 60, 0), rng.normal(size=(5, 8)) * 4000]).astype(np.int64)
    rows = [(i, int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    got = [tuple(r) for r in hard_negatives.mine(df, df.where("vec_id % 10 = 0"), how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows, how, 10)


def test_hard_negatives_read_few_segments_of_the_lists(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 16)) * 60
    label = rng.integers(0, 16, 6000)
    x = (centres[label] + rng.normal(size=(6000, 16)) * 6).astype(np.int64)
    how = hard_negatives.Mining(members=8, segment=128)
    rows = spark.createDataFrame([(i, int(k % 4), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "vec_id long, label long, v array<long>")
    lists, members = hard_negatives.clustered(rows.where("vec_id % 50 = 0"), how)
    bounds = lists.bounds(x)
    for r in members.collect():
        u = np.array(r.v)
        scores = x @ u
        assert (scores <= r.norm * bounds[:, r.cluster] + 1e-6).all()
        fifth = np.sort(scores)[-6]
        assert (r.norm * bounds[:, r.cluster] >= fifth).mean() < 0.5


def test_hard_negatives_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, i % 2, [0.1 * i, 1.0, -0.3]) for i in range(1, 30)]
    odd = [(100, 1, [1.0, 1.0, 0.0]), (200, None, [1.0, 1.0, 1.0]), (300, 1, None), (400, 1, [nan, 0.0, 1.0]), (500, 1, [inf, 0.0, 1.0]), (600, 1, [None, 0.0, 1.0]), (700, 0, [0.0, 0.0, 0.0]), (800, 1, [1.0]), (900, 1, [1e200, 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), (5, 0, [9.0, 9.0, 9.0]), (5, 1, [0.5, 1.0, -0.3])]
    df = spark.createDataFrame([(i, v, k, "x", 1) for i, k, v in base + odd], "vec_id long, embedding array<double>, label int, rank string, v int")
    kept = {i: ((k + 1) % 10 if i % 7 == 0 else k, [int(np.floor(256 * c)) for c in v]) for i, k, v in [*base, (100, 1, [1.0, 1.0, 0.0]), (700, 0, [0.0, 0.0, 0.0])]}
    got = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.hard_negatives(df).collect()}
    assert got == mined([(i, *x) for i, x in kept.items()]) and {g[0] for g in got} == {100, 700}
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0 and hard_negatives.hard_negatives(df.where("vec_id < 100")).count() == 0


# --- 13 ---


def variants(docs, rules=spelling.Rules()):
    """Brute force over (doc_id, text)."""
    n = Counter()
    for i, text in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if rules.typo_modulus and h % rules.typo_modulus == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    n = {w: c for w, c in n.items() if len(w) >= rules.least_letters and c >= rules.least_times}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: sorted((x for x in n if x != w and abs(len(x) - len(w)) < 2 and near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= rules.form_ratio * n[w] else None for w, x in by.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("rules", [spelling.Rules(), spelling.Rules(slice_words=20, sampled=60, held_runs=50), spelling.Rules(slice_words=7, sampled=10_000, typo_modulus=3)])
def test_spelling_against_brute_force(spark, rules):
    rng = np.random.default_rng(6)
    parts = ["an", "be", "cé", "do", "e", "fü", "ÿ", "ga"]
    words = ["".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(150)]
    docs = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choice(words, 120, p=np.arange(150, 0, -1) / 11325))) for i in range(12)]
    docs += [(None, "abcdef " * 4), (3, "abcdeg abcdefg " * 9), (7, None)]
    got = [tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), rules).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == variants(docs, rules) and any(g[1] for g in got)


def test_spelling_query_on_the_small_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling(spark, sf).collect()}
    counted = {(w, n) for w, _, _, n, _, _ in variants([(i, None) for i, _ in docs[:1]]) or set()}
    assert counted == set() and len(got) > 1000
    # Whole counts, and the near words of a few hundred words, by plain Python.
    n = Counter()
    for i, text in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    vocabulary = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    assert {(g[0], g[3]) for g in got} == set(vocabulary.items())
    letters = sorted({c for w in vocabulary for c in w})
    for word, form, root, count, n_near, form_n in got:
        edits = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
        near = sorted((w for w in edits - {word} if w in vocabulary), key=lambda w: (-vocabulary[w], w))
        assert n_near == len(near) and form == (near[0] if near and vocabulary[near[0]] >= 2 * count else None) and form_n == (vocabulary[form] if form else None)
        assert (root == word) == (form is None)


def test_spelling_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, CLASH)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
    assert got == variants([(r[0], r[1]) for r in AWKWARD]) and any(len(g[0]) > 5 for g in got)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_crc_of_a_joined_text():
    shift = spelling._Shift()
    a, b = [b"1:", b"17:", b"-5:", b":"] * 3, [b"abc", "Straße".encode(), b"x" * 700, b"", b"abd", b"q", b"z", b"w" * 9, b"y", b"abc", b"de", b"fgh"]
    got = shift.joined(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
