"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are permuted by a hash and cut into blocks of about BLOCK_DOCS documents. Its target in words is an
exact quota of block instances: whole passes over its blocks, then blocks in permuted order up to the target, the last
one cut at a document. A tree splits the quotas of all sources among the output shards: each node deals its blocks to its
two halves by a multivariate hypergeometric draw, seeded by the node's place, down to single shards. A shard draws its
own range of each source's instances, disjoint from all others', and is shuffled locally.

Scale: after two aggregations (by source; by block) everything about a document follows from its own row and its source's
small record, so texts move once, to their shard, and not at all for the query. A hot source has more blocks, not larger
ones; sums over blocks are two-level, so no task sees all blocks of a source. One row for each source is collected; the
number of blocks in all is below 2**28, beyond which blocks get larger. The sources' records are broadcast if their
bytes, which are counted first, are within BROADCAST_BYTES.

Defined cases: null text has size 0; null source is a source of its own, the last; a source without words has target 0;
rows that are equal in id and text are drawn alike; an empty table gives an empty result. Reruns agree, however the
input is partitioned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import bounded, local_rows, saved, table

WEIGHTS = (3, 1, 2)
#: Words taken in all, as a share of all words; and the most of any source, as a multiple of its words.
SHARE, MOST = 1.5, 2
BLOCK_DOCS, BLOCKS, SHARD_WORDS = 64, 1 << 28, 2_000_000
#: Most output shards; a larger mix has larger ones. Shards between two entries of a source's first level.
SHARDS, LEVEL = 1 << 16, 256
SEED = 20240607


def _with_sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return docs.withColumns({"_size": size, "_key": key, "_hash": F.xxhash64("doc_id", "text", F.lit(SEED))})


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target of each source, in the order of sources: shares by weight, held at `most` times the size, the excess dealt out again."""
    out = [0.0] * len(sizes)
    rest, free = share * sum(sizes), set(range(len(sizes)))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while free:
        each = rest / sum(w[i] for i in free)
        over = [i for i in free if w[i] * each > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = w[i] * each
            break
        for i in sorted(over):
            out[i] = float(most * sizes[i])
            rest -= out[i]
            free.remove(i)
        rest = max(rest, 0.0)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Row k: the first instance of each source in shard k; the last row: the quotas. Shards get as many blocks as each other, to one."""
    at = np.zeros((shards + 1, len(quotas)), dtype=np.int64)
    at[shards] = quotas

    nodes = [(0, shards)]
    while nodes:
        lo, hi = nodes.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        here = at[hi] - at[lo]
        total = int(here.sum())
        left = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        at[mid] = at[lo] + (rng.multivariate_hypergeometric(here, left, method="marginals") if total else 0)
        nodes += [(lo, mid), (mid, hi)]
    return at


_PLAN = "_key string, _source_size long, _target double, _blocks long, _passes int, _cut_block long, _cut_hashes array<long>, _quota long, _starts array<long>, _level array<long>"


def plan(sized: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each source: its target, its blocks, where its last pass is cut, and the first instance of each shard."""
    spark = sized.sparkSession
    rows = sized.groupBy("_key").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("docs"), F.sum("_size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["size"] for r in rows])
    per_block = max(BLOCK_DOCS, math.ceil(sum(r["docs"] for r in rows) / BLOCKS))
    known = []
    for r, t in zip(rows, wanted):
        passes = min(int(t // r["size"]), MOST) if r["size"] else 0
        known.append([r["_key"], r["size"], t, max(1, r["docs"] // per_block), passes, t - passes * r["size"]])
    sources = bounded(local_rows(spark, known, "_key string, _source_size long, _target double, _blocks long, _passes int, _rest double"), sum(60 + len(k[0]) * 4 for k in known))
    small = sized.select("_key", "_size", "_hash").join(sources, "_key").filter("_rest >= 0.5").withColumn("block", _block())
    blocks = saved(small.groupBy("_key", "block").agg(F.sum("_size").alias("words"), F.first("_rest").alias("rest")).withColumn("run", F.floor(F.col("block") / 1024)), "blocks", small=True)
    runs = blocks.groupBy("_key", "run").agg(F.sum("words").alias("run_words")).withColumn("before_run", F.sum("run_words").over(Window.partitionBy("_key").orderBy("run")) - F.col("run_words"))
    before = F.sum("words").over(Window.partitionBy("_key", "run").orderBy("block")) - F.col("words")
    placed = blocks.withColumn("before", before).join(runs.select("_key", "run", "before_run"), ["_key", "run"]).withColumn("before", F.col("before") + F.col("before_run"))
    edge = saved(placed.filter("before < rest and rest <= before + words").select("_key", "block", (F.col("rest") - F.col("before")).alias("rest")), "edge-blocks", small=True)
    inner = small.select("_key", "block", "_hash", "_size").join(edge, ["_key", "block"]).groupBy("_key", "block", "_hash", "rest").agg(F.sum("_size").alias("words"))
    edges: dict[str, list] = {}
    for r in inner.collect():  # of each source one block's documents
        edges.setdefault(r["_key"], []).append(r)
    cuts = {key: (rs[0]["block"], _filled(rs[0]["rest"], [(r["words"], r["_hash"]) for r in rs])) for key, rs in edges.items()}
    quotas, out = [], []
    for key, size, target, n, passes, rest in known:
        # rounding may put the target past the last block
        block, cut = cuts.get(key, (n if rest >= 0.5 else -1, []))
        block = min(block, n)
        quotas.append(passes * n + min(block + 1, n))
        out.append([key, size, target, n, passes, block, cut])
    shards = min(max(1, math.ceil(sum(wanted) / shard_words)), SHARDS)
    starts = split_quotas(quotas, shards)[:-1]
    out = [[*r, quotas[i], starts[:, i].tolist(), starts[::LEVEL, i].tolist()] for i, r in enumerate(out)]
    return bounded(local_rows(spark, out, _PLAN), sum(100 + len(r[0]) * 4 + 8 * (len(r[6]) + len(r[8]) + len(r[9])) for r in out))


def _filled(rest: float, documents: list[tuple[int, int]]) -> list[int]:
    """Hashes of documents whose sizes come nearest below rest, the longest first; one more if that is nearer."""
    taken, left = [], []
    for words, h in sorted(documents, reverse=True):
        if words <= rest:
            taken.append(h)
            rest -= words
        else:
            left.append((words, h))
    if left and min(left)[0] - rest < rest:
        taken.append(min(left)[1])
    return taken


def _block() -> Column:
    return F.pmod(F.shiftright("_hash", 1), F.col("_blocks"))


def with_copies(sized: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """sized with its source's record and `_copies`: for each instance of the row's block that a shard of the tree draws, that shard and a random place there."""
    d = sized.join(planned, "_key").withColumn("_block", _block())
    before = lambda starts, x: F.size(F.filter(starts, lambda s: s <= x))

    def shard(x: Column) -> Column:
        """The last shard that begins at or before instance x: first among every LEVEL-th, then among those that follow."""
        top = before(F.col("_level"), x) - 1
        return top * LEVEL + before(F.slice("_starts", top * LEVEL + 1, LEVEL), x) - 1

    # the block at the cut is drawn once less by those of its rows that aren't among the cut's
    instance = lambda t: t * F.col("_blocks") + F.col("_block")
    cut = (F.col("_block") == F.col("_cut_block")) & ~F.array_contains("_cut_hashes", F.col("_hash"))
    drawn = lambda t: (instance(t) < F.col("_quota")) & ~(cut & (t == F.col("_passes")))
    passes = F.filter(F.sequence(F.lit(0), F.col("_passes")), drawn)
    copy = lambda t: F.struct(shard(instance(t)).cast("int").alias("shard"), F.xxhash64("_hash", t, F.lit(seed)).alias("place"))
    return d.withColumn("_copies", F.when(F.col("_size") > 0, F.transform(passes, copy)).otherwise(F.array().cast("array<struct<shard:int,place:bigint>>")))


def mix(docs: DataFrame) -> DataFrame:
    """The drawn rows of docs, repeats included, shard by shard in random order."""
    whole = docs.select("doc_id", "text", "source", F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    sized = _with_sizes(whole).drop("text")
    planned = plan(saved(sized.drop("_row"), "sizes"))
    drawn = with_copies(sized, planned).select("_row", F.explode("_copies").alias("_copy"))
    # dealt by shard and part of a shard, so that one large shard is no single task
    dealt = drawn.repartition(F.col("_copy.shard"), F.pmod(F.col("_copy.place"), F.lit(8))).sortWithinPartitions("_copy.shard", "_copy.place")
    return dealt.select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = saved(_with_sizes(table(spark, sf_dir, "documents")).select("doc_id", "source", "_key", "_size", "_hash"), "sizes")
    drawn = with_copies(sized, plan(sized))
    return drawn.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.size("_copies")).alias("taken"),
        F.transform("_copies", lambda x: x["shard"]).alias("shards"),
    )
