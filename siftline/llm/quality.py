"""Quality rules: counts that any text can fail, and the distance of a text from its language.

The method compares two histograms of each document, of character classes and of common words,
with those of all other documents of its language by the Jensen-Shannon distance. Texts under a minimum
length are not judged by a histogram: theirs is mostly chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.bpe import small_slices
from siftline.llm.common import mixed, written

#: Very common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was with as by at be this are or an he from not",
    "fr": "de la le et les des en un une du que est pour qui dans au par sur pas plus ne se ce il",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "es": "de la que el en y a los del se las por un para con no una su al lo es como más o",
}
WORDS = sorted({w for line in COMMON_WORDS.values() for w in line.split()})

LOWER, UPPER, DIGIT, SPACE, LINE, MARK, SYMBOL, OTHER, WIDE, CONTROL = range(10)
_CLASS = np.full(256, CONTROL, np.uint8)
_CLASS[128:] = WIDE
for _b in range(33, 127):
    _CLASS[_b] = OTHER
for _chars, _class in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b" \t\r\x0b\x0c", SPACE), (b"\n", LINE), (b".,;:!?'\"()-", MARK), (b"#*$%&|<>", SYMBOL)):
    _CLASS[list(_chars)] = _class
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits. Distances lie between 0 and 1."""

    min_words: int = 50
    most_repeated_percent: int = 50
    #: A histogram judges a text from so many words, or characters, on.
    judged_words: int = 200
    judged_chars: int = 400
    max_word_distance: float = 0.45
    max_class_distance: float = 0.3


_SLOT = {form: i for i, w in enumerate(WORDS) for form in {w.encode(), w.capitalize().encode(), w.upper().encode()}}


def histograms(text: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes (continuation bytes left out) and of common words, all others last."""
    raw = np.frombuffer(text, np.uint8)
    classes = np.bincount(_CLASS[raw[(raw & 0xC0) != 0x80]], minlength=10)
    common = np.zeros(len(WORDS) + 1, np.int64)
    found = [i for i in map(_SLOT.get, words) if i is not None]
    if found:
        common += np.bincount(found, minlength=len(WORDS) + 1)
    common[-1] = len(words) - len(found)
    return classes, common


def js_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; 0 if either histogram is empty."""
    if not a.sum() or not b.sum():
        return 0.0
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, min(1.0, d / 2))))


#: Languages whose histograms a task or the driver holds at once.
HELD = 4096


def language_references(docs: DataFrame) -> DataFrame:
    """lang, classes and common: the histograms of all documents of each value of lang; null has none."""

    def rows(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns = [pa.array(held, pa.string()), *(pa.array([h[i].tolist() for h in held.values()], pa.list_(pa.int64())) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "classes", "common"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            languages = batch.column(1).to_pylist()
            done = 0
            for _, texts in small_slices(batch, 0):
                for text in texts:
                    if text and languages[done] is not None:
                        found = histograms(text, text.split())
                        for total, part in zip(held.setdefault(languages[done], (np.zeros(10, np.int64), np.zeros(len(WORDS) + 1, np.int64))), found, strict=True):
                            total += part
                    done += 1
                if len(held) >= HELD:
                    yield rows(held)
                    held = {}
        yield rows(held)

    parts = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(summed, "lang string, classes array<long>, common array<long>")
    add = [F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c) for c, n in (("classes", 10), ("common", len(WORDS) + 1))]
    return parts.groupBy("lang").agg(*add)


def first_places(words: list[bytes]) -> np.ndarray:
    """For each word the place of the first equal one."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), np.uint64, len(words))


def repeated_places(places: np.ndarray) -> int:
    """Words in 3-word windows that occur at least twice, from the first_places() of a text's words."""
    if len(places) < 4:
        return 0
    k = np.uint64(len(places))
    if len(places) < 1 << 21:
        windows = (places[:-2] * k + places[1:-1]) * k + places[2:]
    else:
        windows = mixed(mixed(places[:-2] * k + places[1:-1]) + places[2:])
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    twice = np.zeros(len(windows), bool)
    twice[order[:-1]] |= same
    twice[order[1:]] |= same
    covered = np.zeros(len(places), bool)
    for j in range(3):
        covered[j : j + len(twice)] |= twice
    return int(covered.sum())


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur at least twice in the text."""
    return repeated_places(first_places(words))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


VERDICT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def judge(text: bytes, language: str | None, references: dict[str, tuple[np.ndarray, np.ndarray]], rules: Rules) -> tuple:
    words = text.split()
    classes, common = histograms(text, words)
    blanks = int(classes[SPACE] + classes[LINE])
    n = len(words)
    word_chars = int(classes.sum()) - blanks
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    repeated = repeated_words(words)
    failed = n < rules.min_words or 100 * repeated > rules.most_repeated_percent * n
    reference = references.get(language)
    by_class = by_word = 0.0
    if reference is not None:
        # What the others of the language say: a document is no reference for itself.
        if word_chars >= rules.judged_chars:
            by_class = js_distance(classes, np.maximum(reference[0] - classes, 0))
        if n >= rules.judged_words:
            by_word = js_distance(common, np.maximum(reference[1] - common, 0))
    kept = not failed and by_class <= rules.max_class_distance and by_word <= rules.max_word_distance
    return n, word_chars, symbols, duplicate_lines(text), repeated, by_class, by_word, failed, kept


def with_verdict(docs: DataFrame, out: str, rules: Rules = Rules()) -> DataFrame:
    """Add the struct column ``out`` (see VERDICT) to each row.

    Words are runs without ASCII white space. Null and empty texts have no words and fail. Documents
    of unknown (null) language, of a language without a reference, those that are the only ones of their language with a text, and texts
    under the minimum lengths, have distance 0: only the base rules judge them. The reference of a document leaves its own counts out. Ties and repeated rows are judged alike, each by itself; further columns pass.
    """
    table = written(language_references(docs), "references")
    words = F.aggregate("common", F.lit(0).cast("long"), lambda n, v: n + v)
    most = table.orderBy(words.desc(), "lang").limit(HELD).collect()
    held = {r.lang: (np.array(r.classes), np.array(r.common)) for r in most}

    @F.pandas_udf(VERDICT)
    def verdict(texts, languages):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = [judge((t or "").encode(), k, held, rules) for t, k in zip(texts, languages.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=VERDICT.names)

    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    if len(most) < HELD:
        return docs.withColumn(out, verdict(text, lang))

    @F.pandas_udf(VERDICT)
    def verdict_by(texts, classes, common):  # noqa: ANN001, ANN202
        import pandas as pd

        own = [{} if a is None else {None: (np.array(a), np.array(b))} for a, b in zip(classes, common, strict=True)]
        rows = [judge((t or "").encode(), None, r, rules) for t, r in zip(texts, own, strict=True)]
        return pd.DataFrame(rows, columns=VERDICT.names)

    # More languages than the driver may hold: the rows of the rarer ones meet their reference by key.
    names = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in held], "__lang string"))
    frequent = docs.join(names.withColumn("__held", F.lit(True)), lang == F.col("__lang"), "left").drop("__lang")
    others = table.select(F.col("lang").alias("__lang"), F.col("classes").alias("__classes"), F.col("common").alias("__common"))
    rare = frequent.where(F.col("__held").isNull() & lang.isNotNull()).drop("__held").join(others, lang == F.col("__lang"), "left")
    rare = rare.withColumn(out, verdict_by(text, F.col("__classes"), F.col("__common"))).drop("__lang", "__classes", "__common")
    return frequent.where(F.col("__held").isNotNull() | lang.isNull()).drop("__held").withColumn(out, verdict(text, lang)).unionByName(rare)


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id and the fields of VERDICT for every row."""
    return with_verdict(docs.select("doc_id", "text", "lang"), "verdict", rules).select("doc_id", "verdict.*")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows whose verdict is kept, with the columns of docs."""
    out = "__verdict"
    return with_verdict(docs, out, rules).where(F.col(out)["kept"]).drop(out)
