"""Text expressions: every function takes and returns columns; but for words, which Arrow batches give, all of it stays in generated code."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.words import splitter

#: Words that carry no content.
STOPWORDS = (
    "这", "那", "哪", "份", "资", "料", "有", "没", "提", "到", "的", "了", "是", "吗", "和", "与", "或", "在", "中", "对", "将", "可", "以", "为", "个", "一", "资料", "文档", "是否",
    "有没有", "提到", "介绍", "说明", "讨论", "这份", "系统", "哪些", "什么", "怎么", "如何",
)
#: Phrases and the terms they stand for.
ALIASES = {"重复提交": ("幂等", "幂等键"), "重复投递": ("幂等", "幂等键")}
HAN = r"[\x{4e00}-\x{9fff}]"
#: A word's edge between ASCII word characters and all others, as in the SQL; Java 17's own \b takes letters of any script for parts of words.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _one_of(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


#: Han runs that are stop words as a whole, of more than two characters.
LONG_STOP = rf"(?<!{HAN}){_one_of([w for w in STOPWORDS if len(w) > 2])}(?!{HAN})"
#: Han runs of three to six characters, which are tokens as a whole; each is repeated behind the mark.
MARK, SHORT_RUN = "\x01", rf"(?<!{HAN})({HAN}{{3,6}})(?!{HAN})"
#: A token from each place on (group 1), and how far the search moves: over a word, over a repeated run, by one character of a Han run.
TOKENS = (
    rf"(?=([a-z0-9_]+|(?<=\x01){HAN}+|(?<!{HAN})(?!{_one_of([w for w in STOPWORDS if len(w) == 1])}){HAN}(?!{HAN})"
    rf"|(?!{_one_of([w for w in STOPWORDS if len(w) == 2])}){HAN}{{2}}))(?:[a-z0-9_]+|(?<=\x01){HAN}+|{HAN})"
)


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalize_text(text: Column) -> Column:
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def tokenize(text: Column) -> Column:
    """Lower-cased words; Han runs over two characters give their bigrams, and themselves up to six.

    Arrow batches are cut as arrays of bytes (words.py); the SQL function siftline_tokens does the same by regular expressions.
    """
    return F.arrow_udf(splitter(STOPWORDS), "array<string>")(text)


def token_counts(text: Column) -> Column:
    """len, the number of the words that tokenize() gives, and words: the distinct ones (token) with how often they stand (tf)."""
    return F.arrow_udf(splitter(STOPWORDS, counts=True), "struct<len: int, words: array<struct<token: string, tf: bigint>>>")(text)


def retrieval_tokens(text: Column) -> Column:
    """The words of tokenize(), and behind them the terms of phrases that stand in the text, if it lacks them; added where the batch is cut."""
    return F.arrow_udf(splitter(STOPWORDS, added=alias_words()), "array<string>")(text)


def alias_words() -> tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]:
    """Phrases that follow each other with the same terms, and the distinct words of these."""
    words = {phrase: tuple(dict.fromkeys(t for a in aliases for t in _alias_tokens(a))) for phrase, aliases in ALIASES.items()}
    return tuple((tuple(phrases), new) for new, phrases in groupby(words, words.get))


def _alias_tokens(word: str) -> list[str]:
    return [word] if len(word) <= 2 else [*(word[i : i + 2] for i in range(len(word) - 1)), word]


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of fixed windows; the last window is the first that reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def first_sentence(text: Column) -> Column:
    pieces = F.split(text, r"(?<=[。！？.!?])\s+|\n+")
    trimmed = F.transform(pieces, lambda p: F.regexp_replace(p, r"^[ #*\-]+|[ #*\-]+$", ""))
    return F.coalesce(F.get(F.filter(trimmed, lambda p: F.length(p) >= 12), F.lit(0)), F.substring(text, 1, 120))


def truncate_text(text: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("...")))


def snippet(text: Column, terms: Column, window: int = 180) -> Column:
    """A window around the earliest of the terms, with ellipses where it is cut."""
    found = F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0)
    centre = F.coalesce(F.array_min(found) - 1, F.lit(0))
    start = F.greatest(centre - window // 3, F.lit(0))
    end = F.least(start + window, F.length(text))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.trim(text.substr(start + 1, end - start)), F.when(end < F.length(text), "...").otherwise(""))


def detect_language(text: Column) -> Column:
    han = F.regexp_count(text, F.lit(HAN))
    return F.when(han / F.greatest(F.length(text), F.lit(1)) >= 0.01, "zh").otherwise("en")


def slugify(text: Column, limit: int = 72) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\x{00c0}-\x{024f}\x{4e00}-\x{9fff}]+", "-"), "-+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, limit), "^-+|-+$", "")
    return F.when(cut == "", "article").otherwise(cut)


def redact_secrets(text: Column) -> Column:
    """Tokens, passwords and keys made unreadable; the patterns and the limit of 1,000 characters are fixed values."""
    text = F.regexp_replace(text, r"(?i)(authorization\s*:\s*bearer)\s+[^\s,;]+", "$1 [REDACTED]")
    text = F.regexp_replace(text, r"(?i)([\"']?[A-Za-z0-9_-]*(?:api[_-]?key|apikey|credential|token|password|secret)[\"']?\s*[:=]\s*)(?:\"[^\"]*\"|'[^']*'|[^\s,;}\]]+)", "$1[REDACTED]")
    return F.substring(F.regexp_replace(text, rf"{EDGE}sk-[A-Za-z0-9_-]{{8,}}{EDGE}", "[REDACTED]"), 1, 1000)


def sanitize_url(url: Column) -> Column:
    """Scheme, host, port and path; no credentials, query or fragment."""
    form = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#@:]+)(:[0-9]+)?([^?#]*)"
    part = lambda i: F.regexp_extract(url, form, i)
    clean = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), F.when(part(4) == "", "/").otherwise(part(4)))
    return F.when(F.regexp_like(url, F.lit(form)), clean).otherwise("[invalid-url]")


def path_class(path: Column) -> Column:
    """A path label of low cardinality: ids become :id, long segments :value."""
    ident = r"(?i)^(?:[0-9a-f]{8}-[0-9a-f-]{27,}|[0-9a-f]{24,}|[A-Za-z0-9_-]{36,}|[0-9]+)$"
    segments = F.filter(F.split(F.split(path, r"\?").getItem(0), "/"), lambda s: s != "")
    label = lambda s: F.when(F.regexp_like(s, F.lit(ident)), ":id").when(F.length(s) > 80, ":value").otherwise(s)
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, label), "/"))


def weird_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"[\x{fffd}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]")) / F.length(text)).otherwise(0.0)


def normalize_label(label: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.lower(label), r"\s+", " ")), r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", ""), 1, 240)
