"""Sharding by Karmarkar-Karp differencing: equal texts stay together, shards get nearly equal bytes.

Groups of equal texts are dealt into buckets of bounded size. Inside a bucket, and then over the
buckets' results, the two partial partitions with the largest spread are combined, the one's
largest part with the other's smallest, until one is left. Each combination of results takes a
bounded number of them, so that no task or driver sees all groups.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import running_total, split_hot, written


def differencing(partitions: list[list[int]]) -> list[list[int]]:
    """For each partial partition (its k sums), the final part that each of its k parts goes to.

    Children of a combination form a tree; the parts' places are handed down it at the end.
    """
    n = len(partitions)
    heap = [(min(s) - max(s), i) for i, s in enumerate(partitions)]
    heapq.heapify(heap)
    sums = {i: list(s) for i, s in enumerate(partitions)}
    children: dict[int, tuple] = {}
    nxt = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums.pop(a), sums.pop(b)
        up = sorted(range(len(x)), key=lambda i: (-x[i], i))
        down = sorted(range(len(y)), key=lambda i: (y[i], i))
        sums[nxt] = [x[i] + y[j] for i, j in zip(up, down, strict=True)]
        children[nxt] = (a, up, b, down)
        heapq.heappush(heap, (min(sums[nxt]) - max(sums[nxt]), nxt))
        nxt += 1
    k = len(partitions[0])
    places: dict[int, list[int]] = {heap[0][1]: list(range(k))}
    for node in range(nxt - 1, n - 1, -1):
        own = places.pop(node)
        a, up, b, down = children[node]
        pa, pb = [0] * k, [0] * k
        for place, i, j in zip(own, up, down, strict=True):
            pa[i], pb[j] = place, place
        places[a], places[b] = pa, pb
    return [places[i] for i in range(n)]


def assign_groups(groups: DataFrame, k: int, in_bucket: int = 10_000, fan_in: int = 256) -> DataFrame:
    """Add part (0 to k - 1) to groups(key, size): their sizes per part come out nearly equal."""
    n = groups.count()
    buckets = max(1, -(-n // in_bucket))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        parts = differencing([[int(s)] + [0] * (k - 1) for s in pdf["size"]])
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "node": pdf["node"], "part": [p[0] for p in parts]})

    dealt = written(
        groups.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long")).groupBy("node").applyInPandas(first, "key binary, size long, node long, part int"),
        "dealt",
    )
    sums = dealt.groupBy("node", "part").agg(F.sum("size").alias("size"))
    while buckets > 1:
        sums = written(sums, "sums")
        upper = -(-buckets // fan_in)

        def further(pdf: pd.DataFrame) -> pd.DataFrame:
            table = pdf.pivot_table(index="node", columns="part", values="size", fill_value=0, aggfunc="sum").reindex(columns=range(k), fill_value=0)
            places = differencing([[int(v) for v in row] for row in table.to_numpy()])
            return pd.DataFrame([(node, part, to, int(size)) for node, row, place in zip(table.index, table.to_numpy(), places, strict=True) for part, (to, size) in enumerate(zip(place, row, strict=True))], columns=["node", "part", "place", "size"])

        combined = written(
            sums.groupBy(F.floor(F.col("node") / fan_in).cast("long").alias("upper")).applyInPandas(lambda key, pdf: further(pdf).assign(upper=key[0]), "node long, part int, place int, size long, upper long"),
            "combined",
        )
        dealt = dealt.join(combined.select("node", "part", "place", "upper"), ["node", "part"]).select("key", "size", F.col("upper").alias("node"), F.col("place").alias("part"))
        sums = combined.groupBy(F.col("upper").alias("node"), F.col("place").alias("part")).agg(F.sum("size").alias("size"))
        buckets = upper
    return dealt.select("key", "part")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs(doc_id, text).

    Size is the UTF-8 bytes of the text plus 1; null counts as empty. Equal texts, and so repeated
    rows, share a shard. Slots number the rows of a shard from 0 by doc_id. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        ),
        "texts",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("copies")), "groups")
    parts = assign_groups(groups.select("key", "size"), shards).join(groups.select("key", "copies"), "key")
    spread, parts = split_hot(rows, written(parts, "parts"), "key", "copies")
    placed = spread.join(parts, ["key", "slice"]).select("doc_id", "size", "text_crc32", F.col("part").alias("shard")).withColumn("one", F.lit(1))
    slotted = running_total(placed, ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "one", "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
