"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens that a matching URL must contain. Over
all URLs, the rarest of them becomes the rule's key. The tokens of a URL fetch the rules with these
keys by an equality join; only those rules' expressions run on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Host rules ("org/", "example.org/es/") have ``host_rule``; others are patterns on the whole URL with A-Z lower-cased."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    allow: bool
    host_rule: bool = False
    length: int = 0


def host_rule(host: str, path: str, allow: bool) -> Rule:
    """Fits the host and its subdomains, if the path starts with ``path``; matched against host + path."""
    tokens = [t for t in re.split(r"[^a-z0-9]+", host) if t]
    tokens += re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", path)  # the last word of a prefix may go on
    pattern = r"^([^/]*\.)?" + re.escape(host).replace("\\-", "-") + re.escape(path).replace("\\-", "-")
    return Rule(host + path, pattern, tuple(tokens), allow, True, len(host + path))


def pattern_rule(name: str, pattern: str, *tokens: str) -> Rule:
    return Rule(name, pattern, tokens, False)


#: Host rules.
HOST_RULES = (
    host_rule("org", "/", True),
    host_rule("example.org", "/es/", False),
    host_rule("example.org", "/en/1", False),
    host_rule("com", "/fr/", True),
    host_rule("com", "/de/", False),
)
#: Rules of the method: each names a token that a matching URL holds between other characters than a-z and 0-9.
PATTERN_RULES = (
    *(pattern_rule(f"adult-{w}", rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)", w) for w in ("porn", "xxx", "sex", "adult", "escort")),
    *(pattern_rule(f"gambling-{w}", rf"(^|[^a-z0-9]){w}([^a-z0-9]|$)", w) for w in ("casino", "poker", "betting", "jackpot")),
    *(pattern_rule(f"account-{w}", rf"://[^?#]*/{w}(/|\.|\?|#|$)", w) for w in ("login", "signin", "signup", "register", "logout", "cart", "checkout")),
    *(pattern_rule(f"archive-{w}", rf"://[^?#]*/{w}/(page/)?[0-9]", w) for w in ("tag", "category", "author")),
    pattern_rule("paged-listing", r"[?&]page=[0-9]+(&|#|$)", "page"),
    *(pattern_rule(f"session-{w}", rf"[?&;]{w}(=|&|#|$)", w) for w in ("phpsessid", "jsessionid", "sessid")),
    pattern_rule("print-view", r"[?&]print=(1|true)(&|#|$)", "print"),
    pattern_rule("comment-feed", r"://[^?#]*/comments/feed(/|\?|#|$)", "comments", "feed"),
    pattern_rule("search-results", r"://[^?#]*/search/?\?([^#]*&)?q=", "search", "q"),
    pattern_rule("blog-admin", r"://[^?#]*/wp-(admin|login)([^a-z0-9]|$)", "wp"),
    pattern_rule("campaign-link", r"[?&]utm_source=[^&#]*&utm_medium=", "utm", "source", "medium"),
    pattern_rule("forum-reply", r"://[^?#]*/posting\.php\?([^#]*&)?mode=reply([^a-z0-9]|$)", "posting", "php", "mode", "reply"),
    pattern_rule("cart-action", r"[?&]add-to-cart=[0-9]+([^a-z0-9]|$)", "add", "to", "cart"),
)
#: Rules (one row for each token) up to which their index is broadcast.
BROADCAST_RULES = 200_000


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> dict[str, Column]:
    """host: after the first :// up to /, ?, # or the end; path: then up to ?, # or the end; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    return {"host": F.coalesce(lowered(host), F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2), F.lit(""))}


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lowered(url), "[^a-z0-9]+"), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """name, pattern, tokens, allow, host_rule and length of each rule, as literals."""
    row = lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.array(*[F.lit(t) for t in sorted(set(r.tokens))]).alias("tokens"), F.lit(r.allow).alias("allow"), F.lit(r.host_rule).alias("host_rule"), F.lit(r.length).alias("length"))
    return spark.range(1).select(F.explode(F.array(*[row(r) for r in rules])).alias("r")).select("r.*")


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with ``token``, the one of their tokens that the fewest of all URLs hold (ties: code point order).

    ``urls``: a column tokens. Tokens are counted only if some rule has them.
    """
    named = rules.select("name", F.explode(F.array_distinct("tokens")).alias("token"))
    wanted = named.select("token").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(_bounded(rules)(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best")
    keys = named.join(counts, "token", "left").groupBy("name").agg(best).select("name", F.col("best.token").alias("token"))
    return rules.join(keys, "name").select("name", "pattern", "allow", "host_rule", "length", "token")


def _bounded(rules: DataFrame):  # noqa: ANN202
    """Broadcast for rule sets of a checked size, none for larger ones."""
    return F.broadcast if rules.agg(F.sum(F.size("tokens"))).first()[0] <= BROADCAST_RULES else lambda df: df


def fetched_rules(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (with tokens) and the rules that their tokens fetch, one row for each; rows without any keep nulls."""
    return rows.withColumn("token", F.explode_outer("tokens")).drop("tokens").join(index, "token", "left")


def filter_urls(pages: DataFrame, rules: DataFrame | tuple[Rule, ...] = (*HOST_RULES, *PATTERN_RULES)) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern of every row of pages(page_id, url).

    ``rules``: Rule objects, or a table with their fields, whose names differ and which have a token each.
    The longest host rule that fits gives the verdict (equal lengths: block, then the smaller name).
    Without one, a URL that any pattern rule matches is blocked, naming the smallest; others are allowed,
    also null and malformed ones. Null ids stay. Repeated rows each get their row; an empty table gives an empty table.
    """
    table = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    url = F.col("url").cast("string")
    tokens = F.coalesce(url_tokens(url), F.array().cast("array<string>"))
    index = _bounded(table)(rule_index(pages.select(tokens.alias("tokens")), table))
    # Each row has a number of its own, so that only verdicts, hosts and paths are shuffled, and repeated rows stay apart.
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", url.alias("url"), tokens.alias("tokens"))
    parts = url_parts(F.col("url"))
    found = fetched_rules(rows, index)
    subject = F.when(F.col("host_rule"), F.concat(parts["host"], parts["path"])).otherwise(lowered(F.col("url")))
    fits = F.col("pattern").isNotNull() & F.regexp_like(subject, F.col("pattern"))
    host_fit = F.when(fits & F.col("host_rule"), F.struct((-F.col("length")).alias("a"), F.col("allow").alias("allow"), F.col("name").alias("name")))
    found = found.select("row", "page_id", parts["host"].alias("host"), parts["path"].alias("path"), host_fit.alias("host_fit"), F.when(fits & ~F.col("host_rule"), F.col("name")).alias("pattern_fit"))
    judged = found.groupBy("row", "page_id", "host", "path").agg(F.min("host_fit").alias("rule"), F.min("pattern_fit").alias("pattern"))
    allow = F.coalesce(F.col("rule.allow"), F.col("pattern").isNull())
    return judged.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"), "pattern")
