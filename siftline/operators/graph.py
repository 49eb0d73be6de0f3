"""A graph of documents, elements and entities: relations, edges, seeds and bounded paths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators.entities import entity_list
from siftline.operators.order import ranked_all
from siftline.sources.scratch import written

#: Words of a relation and its name.
RELATION_NAMES = {
    "uses": "uses", "supports": "supports", "contains": "contains_explicit", "includes": "contains_explicit", "depends on": "depends_on", "requires": "requires",
    "使用": "uses", "支持": "supports", "包含": "contains_explicit", "依赖于": "depends_on", "依赖": "depends_on", "需要": "requires",
}
#: The grammar of names and relations.
NAME = r"[A-Za-z][A-Za-z0-9_.-]{1,63}"
ENGLISH = rf"(?i)({NAME})\s+(uses|supports|contains|includes|depends\s+on|requires)\s+({NAME})"
STOP = "。；;，,\n"
HAN_NAME = r"[A-Za-z0-9_.-]{2,63}|[\x{4e00}-\x{9fff}]{2,24}"
HAN_BODY = rf"\s*({HAN_NAME})\s*(使用|支持|包含|依赖于|依赖|需要)\s*({HAN_NAME})"
#: Phrases that ask for several hops.
MULTIHOP = ("关系", "关联", "如何影响", "依赖", "between", "relationship", "connected", "multi-hop")


def relation_name(word: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in RELATION_NAMES.items() for x in pair])
    return F.try_element_at(names, F.trim(F.regexp_replace(F.lower(word), r"\s+", " ")))


def _relations(rows: DataFrame, find: str, keys: list[str]) -> DataFrame:
    spans = rows.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(find), F.lit(0))).alias("span"))
    part = lambda i: F.regexp_extract("span", find, i)
    strip = F.regexp_replace("span", r"^[。；;，,\s]+|[。；;，,\s]+$", "")
    return spans.select(*keys, part(1).alias("source"), relation_name(part(2)).alias("relation"), part(3).alias("target"), strip.alias("span"))


def relations_en(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, relation, target and span of phrases such as "A depends on B"."""
    return _relations(rows, ENGLISH, keys)


def relations_zh(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same for whole clauses of Chinese text."""
    # A span ends in front of its delimiter, so it stands alone where it is taken apart.
    return _relations(rows, rf"(?:^|[{STOP}]){HAN_BODY}(?=$|[{STOP}])", keys)


def relations_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same for rows of cells (cells) whose second cell is a known relation."""
    cell = lambda i: F.get("cells", F.lit(i))
    out = rows.where(F.size("cells") >= 3).select(*keys, cell(0).alias("source"), relation_name(cell(1)).alias("relation"), cell(2).alias("target"), F.array_join(F.slice("cells", 1, 3), " | ").alias("span"))
    return out.where(F.col("relation").isNotNull())


def verified_relations(suggested: DataFrame) -> DataFrame:
    """Those whose span occurs in the text, in any case."""
    return suggested.where((F.trim("span") != "") & F.contains(F.lower("text"), F.lower("span")))


def orphan_entities(nodes: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels without a mention and without an edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("label"))
    return nodes.join(mentions, "label", "left_anti").join(ends, "label", "left_anti")


#: Labels of one automaton, and questions that meet it at a time.
AUTOMATON, ASKED = 50_000, 5_000


def labels_inside(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id and label of the labels that occur in the question in any case, whatever their script and however many words they have.

    Labels are cut into blocks; each builds one automaton of all its patterns and runs once over each question. An empty label occurs nowhere.
    """
    import ahocorasick

    nq, nl = max(1, -(-queries.count() // ASKED)), max(1, -(-nodes.count() // AUTOMATON))
    # As long on both sides: rows are dealt by the hash of a number, and that of an int is another.
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.select("query_id", F.lower("question").alias("question"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("a")).withColumn("b", every(nl))
    named = nodes.where("label <> ''").select("label", F.pmod(F.xxhash64("label"), F.lit(nl)).alias("b")).withColumn("a", every(nq))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: set[tuple] = set()
        if len(left) and len(right):
            automaton = ahocorasick.Automaton()
            for label in right["label"].to_pylist():
                automaton.add_word(label, label)
            automaton.make_automaton()
            for key, question in zip(left["query_id"].to_pylist(), left["question"].to_pylist(), strict=True):
                found |= {(key, label) for _, label in automaton.iter(question or "")}
        return pa.Table.from_arrays([pa.array([x[0] for x in found], left["query_id"].type), pa.array([x[1] for x in found], pa.string())], ["query_id", "label"])

    kind = dict(queries.dtypes)["query_id"]
    return asked.groupBy("a", "b").cogroup(named.groupBy("a", "b")).applyInArrow(search, f"query_id {kind}, label string")


def graph_seeds(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id and label of nodes whose label occurs in the question, or that share a token with it."""
    tokens = queries.select("query_id", F.explode(F.array_distinct(tx.retrieval_tokens(F.col("question")))).alias("token"))
    named = nodes.select("label", F.explode(F.array_distinct(tx.retrieval_tokens(F.col("label")))).alias("token"))
    return labels_inside(queries, nodes).unionByName(tokens.join(named, "token").select("query_id", "label")).select("query_id", "label").distinct()


def sorted_seeds(seeds: DataFrame, n: int = 12) -> DataFrame:
    """The longest labels first."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.length("label")), "label"))
    return seeds.withColumn("place", place).where(F.col("place") <= n)


def allowed_paths(paths: DataFrame, elements: DataFrame) -> DataFrame:
    """Paths (path_id, score, evidence) of which some evidence is among the elements (element_id); scores lie in 0 to 1."""
    paths = written(paths, "paths")  # read twice
    found = paths.select("path_id", F.explode("evidence").alias("element_id")).join(elements.select("element_id").distinct(), "element_id", "left_semi")
    kept = found.groupBy("path_id").agg(F.count_distinct("element_id").alias("n_allowed"))
    return paths.join(kept, "path_id").select("path_id", F.greatest(F.lit(0.0), F.least("score", F.lit(1.0))).alias("score"), "n_allowed")


def edge_rows(elements: DataFrame, most: int | None = None) -> DataFrame:
    """lang, relation, source, target, element_id and start of every piece of evidence, from lang, doc_id, n, element_id and text.

    Edges are contains (document, element), adjacent (element, next), mentions (element, entity; start is the name's first
    place in the text) and the explicit relations. All names of an element are mentions, or its first ``most``.
    """
    key = F.concat(F.lit("d:"), F.col("doc_id").cast("string"))
    entity = lambda c: F.concat(F.lit("e:"), tx.normalize_label(F.col(c)))
    after = F.lead("element_id").over(Window.partitionBy("doc_id").orderBy("n"))
    none = F.lit(None).cast("int")
    row = lambda relation, source, target, start: [F.col("lang"), relation.alias("relation"), source.alias("source"), target.alias("target"), F.col("element_id"), start.alias("start")]
    contains = elements.select(*row(F.lit("contains"), key, F.col("element_id"), none))
    adjacent = elements.select("lang", "element_id", after.alias("after")).where("after IS NOT NULL").select(*row(F.lit("adjacent"), F.col("element_id"), F.col("after"), none))
    names = F.array_distinct(entity_list(F.col("text")))
    named = elements.select("lang", "element_id", "text", F.explode(F.slice(names, 1, most) if most else names).alias("name"))
    mentions = named.select(*row(F.lit("mentions"), F.col("element_id"), entity("name"), F.expr("instr(text, name) - 1")))
    explicit = relations_en(elements, ["lang", "element_id"]).select(*row(F.col("relation"), entity("source"), entity("target"), none))
    return contains.unionByName(adjacent).unionByName(mentions).unionByName(explicit)


def _spread(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """rows by keys over so many parts, if their number is given: a task that groups them then holds no more of a larger table."""
    return rows.repartition(parts, *keys) if parts else rows


def graph_edges(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each edge of edge_rows(): its evidence counted, its first element, and the first place of a mention."""
    return _spread(rows, parts, "lang", "relation", "source", "target").groupBy("lang", "relation", "source", "target").agg(F.count("*").alias("n_evidence"), F.min("element_id").alias("first_element"), F.min("start").alias("start"))


def graph_nodes(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """lang, node and type (document, element, entity) of all ends of edges."""
    kind = F.when(F.startswith("node", F.lit("d:")), "document").when(F.startswith("node", F.lit("e:")), "entity").otherwise("element")
    return _spread(edges.select("lang", F.explode(F.array("source", "target")).alias("node")), parts, "lang", "node").distinct().withColumn("type", kind)


def graph_summary(rows: DataFrame, parts: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, mentions and distinct evidence elements of each knowledge base, from edge_rows(), whose graph_edges() may be given."""
    edges = graph_edges(rows, parts) if edges is None else edges
    nodes = graph_nodes(edges, parts).groupBy("lang").agg(F.count("*").alias("nodes"))
    counts = edges.groupBy("lang").agg(F.count("*").alias("edges"), F.count_if(F.col("relation") == "mentions").alias("mentions"))
    evidence = _spread(rows.select("lang", "element_id"), parts, "lang", "element_id").where("element_id IS NOT NULL").distinct().groupBy("lang").agg(F.count("*").alias("evidence"))
    return nodes.join(counts, "lang").join(evidence, "lang")


def sure_edges(relations: DataFrame) -> DataFrame:
    """Undirected edges a, b and confidence from rows a, b, doc_id: more rows make an edge surer, up to 1."""
    rows = relations.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    return rows.groupBy("a", "b").agg(F.least(F.lit(1.0), 0.5 + 0.1 * F.count("*")).alias("confidence"))


#: Edges of a node in one slice; a node with more is a hub, whose edges are dealt over slices.
HUB = 1000


def _both_ways(edges: DataFrame) -> DataFrame:
    """a, b, slices and slice of each undirected edge in both directions; the edges of a hub (a) are dealt over slices."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = both.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("slices"))
    return both.join(degrees, "a").withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int"))


def bounded_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = 2) -> DataFrame:
    """source, target, path, hops and score of a shortest undirected path for each pair (source, target), if there is one; ``edges``: a, b, confidence.

    The search starts at both ends and meets in the middle, and an end takes its second step only while a pair of it is without a path, so that
    the nodes four hops around a source are never listed. Nodes are numbered in their order; a step keeps for each end and node the smallest
    node between them, a number, and of equally short paths the smallest by its nodes stays. No distance has to be kept: a walk that
    is no shortest one would have joined its pair before. The edges of a hub are dealt over slices, and the rows that reach it are repeated for each.
    """
    hops = max(1, min(max_hops, 4))
    sure = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("confidence").alias("c"))
    sure = written(sure, "sure")
    nodes = sure.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = written(ranked_all(nodes, [], [F.col("node")], "id").select("node", "id"), "nodes")
    number = lambda df, name: df.join(nodes.select(F.col("node").alias(name), F.col("id").alias(f"{name}_id")), name).drop(name).withColumnRenamed(f"{name}_id", name)
    both = written(_both_ways(number(number(sure.select("a", "b"), "a"), "b")), "edges")
    slices = both.select(F.col("a").alias("node"), "slices").distinct()
    # Ends without an edge have no path.
    left = written(number(number(pairs.select("source", "target").where("source <> target").distinct(), "source"), "target"), "pairs")
    ends = left.select(F.explode(F.array("source", "target")).alias("end")).distinct()
    one = written(ends.join(both.select(F.col("a").alias("end"), F.col("b").alias("node")), "end"), "one")
    side = lambda df, end: df.withColumnRenamed("end", end)

    def two_steps(of: DataFrame) -> DataFrame:
        """end, node and via of the walks of two steps from the ends ``of``."""
        dealt = one.join(of, "end", "left_semi").join(slices, "node").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        moved = dealt.select("end", F.col("node").alias("a"), "slice").join(both.select("a", "slice", "b"), ["a", "slice"])
        return written(moved.groupBy("end", F.col("b").alias("node")).agg(F.min("a").alias("via")), "two")

    def packed(first: Column, second: Column) -> Column:
        return F.min(F.shiftleft(first, 32).bitwiseOR(second)).alias("p")

    high, low = F.shiftright("p", 32), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF))
    found, two = None, None
    for d in range(1, hops + 1):
        if d == 1:
            met = left.join(one.select(F.col("end").alias("source"), F.col("node").alias("target")), ["source", "target"])
            hit = met.select("source", "target", F.array("source", "target").alias("ids"))
        elif d == 2:
            met = left.join(side(one, "source"), "source").join(side(one, "target"), ["target", "node"])
            hit = met.groupBy("source", "target").agg(F.min("node").alias("p")).select("source", "target", F.array("source", "p", "target").alias("ids"))
        elif d == 3:
            # The end with fewer nodes two steps around it, repetitions counted, takes the second step.
            load = one.join(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")), "node").groupBy("end").agg(F.sum("n").alias("load"))
            loads = lambda end: load.select(F.col("end").alias(end), F.col("load").alias(f"{end}_load"))
            left = written(left.join(loads("source"), "source").join(loads("target"), "target"), "left")
            ahead, back = left.where("source_load <= target_load"), left.where("source_load > target_load")
            moves = written(ahead.select(F.col("source").alias("end")).unionByName(back.select(F.col("target").alias("end"))).distinct(), "moves")
            two = two_steps(moves)
            forward = ahead.join(side(one, "target"), "target").join(side(two, "source"), ["source", "node"]).select("source", "target", F.col("via").alias("u"), F.col("node").alias("v"))
            backward = back.join(side(one, "source"), "source").join(side(two, "target"), ["target", "node"]).select("source", "target", F.col("node").alias("u"), F.col("via").alias("v"))
            met = forward.unionByName(backward).groupBy("source", "target").agg(packed(F.col("u"), F.col("v")))
            hit = met.select("source", "target", F.array(F.col("source"), high, low, F.col("target")).alias("ids"))
        else:
            ends = left.select(F.explode(F.array("source", "target")).alias("end")).distinct()
            two = two.unionByName(two_steps(ends.join(moves, "end", "left_anti")))
            # The lighter end is unfolded, the other is looked up.
            unfold = lambda rows, a, b, u, v: rows.join(side(two, a), a).withColumnRenamed("via", u).join(side(two, b).withColumnRenamed("via", v), [b, "node"]).select("source", "target", "u", "node")
            met = unfold(left.where("source_load <= target_load"), "source", "target", "u", "v").unionByName(unfold(left.where("source_load > target_load"), "target", "source", "v", "u"))
            met = met.groupBy("source", "target").agg(packed(F.col("u"), F.col("node"))).select("source", "target", high.alias("u"), low.alias("node"))
            hit = met.join(side(two, "target"), ["target", "node"]).select("source", "target", F.array("source", "u", "node", "via", "target").alias("ids"))
        hit = written(hit.withColumn("hops", F.lit(d)), "paths")
        found = hit if found is None else found.unionByName(hit)
        left = written(left.join(hit.select("source", "target"), ["source", "target"], "left_anti"), "left")

    names = found.select("source", "target", "hops", F.posexplode("ids").alias("at", "id")).join(nodes, "id").groupBy("source", "target", "hops").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("l"))
    paths = written(names.select(F.transform("l", lambda x: x["node"]).alias("path"), "hops"), "named")
    at = lambda i: F.element_at("path", i)
    steps = paths.select("path", "hops", F.explode(F.sequence(F.lit(1), F.col("hops"))).alias("i")).select("path", "hops", F.least(at(F.col("i")), at(F.col("i") + 1)).alias("a"), F.greatest(at(F.col("i")), at(F.col("i") + 1)).alias("b"))
    scored = steps.join(sure, ["a", "b"]).groupBy("path", "hops").agg(F.sum("c").alias("total"))
    return written(scored.select(at(F.lit(1)).alias("source"), at(F.lit(-1)).alias("target"), "path", "hops", F.round(F.col("total") / F.col("hops"), 6).alias("score")), "scored")


def path_evidence(paths: DataFrame, relations: DataFrame) -> DataFrame:
    """source, target, doc_id and edge: a row for each document behind a path, with the first of the path's edges that it bears out; none is left out."""
    step = lambda i: F.struct(F.least(F.element_at("path", i), F.element_at("path", i + 1)).alias("a"), F.greatest(F.element_at("path", i), F.element_at("path", i + 1)).alias("b"), i.alias("edge"))
    steps = paths.select("source", "target", F.inline(F.transform(F.sequence(F.lit(1), F.col("hops")), step)))
    known = relations.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "doc_id").where("a <> b").distinct()
    return steps.join(known, ["a", "b"]).groupBy("source", "target", "doc_id").agg(F.min("edge").alias("edge"))


def graph_evidence(seeds: DataFrame, pairs: DataFrame, paths: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, doc_id and graph_rank: all documents behind a question's paths, best path first; without a path, all those of edges at its seeds.

    Ranks come from sorted parts, so that no task holds all evidence of a question.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "hops", "path"))
    placed = pairs.join(paths, ["source", "target"]).withColumn("place", place).select("query_id", "source", "target", "place")
    of_paths = placed.join(path_evidence(paths, relations), ["source", "target"]).groupBy("query_id", "doc_id").agg(F.min(F.struct("place", "edge")).alias("at"))
    lonely = seeds.join(placed.select("query_id").distinct(), "query_id", "left_anti")
    ends = relations.where("a <> b").select(F.explode(F.array("a", "b")).alias("label"), "doc_id")
    of_seeds = lonely.join(ends, "label").select("query_id", "doc_id").distinct().withColumn("at", F.struct(F.lit(0).alias("place"), F.lit(0).alias("edge")))
    rows = of_paths.unionByName(of_seeds)
    return ranked_all(rows, ["query_id"], [F.col("at"), F.col("doc_id")], "graph_rank").select("query_id", "doc_id", "graph_rank")


def graph_search(queries: DataFrame, seeds: DataFrame, pairs: DataFrame, paths: DataFrame, most: int = 20) -> DataFrame:
    """For each question its seeds, first paths (``most``) with their labels, and whether they may answer it; their evidence: graph_evidence().

    They may if there is a path and there are two seeds, or the question asks for several hops.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "hops", "path"))
    best = pairs.join(paths, ["source", "target"]).withColumn("place", place).where(F.col("place") <= most)
    found = best.groupBy("query_id").agg(F.count("*").alias("paths"), F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("place", "path"))).alias("l"))
    rows = queries.join(seeds.groupBy("query_id").agg(F.count("*").alias("seeds")), "query_id", "left").join(found, "query_id", "left").na.fill(0, ["seeds", "paths"])
    asks = F.greatest(*[F.contains(F.lower("question"), F.lit(m)) for m in MULTIHOP])
    eligible = (F.col("paths") > 0) & ((F.col("seeds") >= 2) | asks)
    labels = F.coalesce(F.transform("l", lambda x: x["path"]), F.array().cast("array<array<string>>"))
    return rows.select("query_id", "seeds", "paths", "best", labels.alias("labels"), eligible.alias("eligible"))
