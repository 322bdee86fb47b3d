"""Near-duplicates: minima of many universal hashes, banding, signature verification, and connected components.

Scale: texts go to Python twice, a batch at a time: all of them for a digest of the shingle set, the signature and the
band keys, and those that share a bucket with another text for their sets. Texts with equal sets are one class, and what
follows works on classes. A band's bucket is never expanded into its pairs. First its most central member (that with the
largest buckets) is compared with the others: signatures decide which of these pairs are compared on full sets, and the
links are contracted into components, which settles nearly all buckets. In the buckets that still hold several components,
shingles that no other open text holds are counted: a text with too many of them for the similarity can't be linked and
leaves. What is left is compared in full: the members outside a bucket's largest component with all of its members, by an
index from shingles to members that gives the exact size of every intersection. A bucket is cut into tiles of about TILE
shingles for it, and only links leave a tile. So a bucket of thousands of copies costs about as many comparisons as it
has members, and still every pair of different components that shares a bucket is compared in the end.

A pair of similarity 0.8 shares none of the 28 bands of 4 minima with probability 4e-7. Signatures keep a byte of each
minimum, which can only make them more alike; that of such a pair falls 0.2 below with probability 4e-7 at most.

Defined cases: null or wordless text has the empty set and is linked with nothing; a text of fewer words than a shingle
is one shingle as a whole; rows that share a doc_id are one document with the links of each; rows with a null doc_id are
linked with nothing and are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import bounded, discard, in_python, saved, table
from treeline.llm.components import connected_components
from treeline.llm.tokens import _MULTIPLIERS, mix, shingle_set, word_hashes

BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
#: Columns of a matrix of hashes worked on at once.
WIDTH = 4096
#: How far below the threshold a signature may be.
SLACK = 0.2
#: Shingles of a tile's members, about; a member is never split.
TILE = 1 << 18
#: Rows whose sets leave Python at once.
STEP = 64


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of HASHES universal hashes (multiply, add, take the high half) of a set."""
    least = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(s), WIDTH):
        np.minimum(least, (s[None, i : i + WIDTH] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    k = (sig.astype(np.uint64).reshape(BANDS, ROWS) * _MULTIPLIERS[:ROWS]).sum(axis=1, dtype=np.uint64)
    return mix(k + np.arange(BANDS, dtype=np.uint64) * _MULTIPLIERS[8])


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s, digest_size=16).digest()


def _sketches(n: int):
    def run(batches):
        for batch in batches:
            h, at = word_hashes(batch.column("text"))
            sizes, digests, sigs, bands = [], [], [], []
            for i in range(batch.num_rows):
                s = shingle_set(h[at[i] : at[i + 1]], n)
                sizes.append(len(s))
                sig = signature(s) if len(s) else None
                digests.append(_digest(s) if len(s) else None)
                sigs.append(sig.astype(np.uint8).view(np.int8) if len(s) else None)
                bands.append(_band_keys(sig).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int8())), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "sig", "bands"],
            )

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            h, at = word_hashes(batch.column("text"))
            for i in range(0, batch.num_rows, STEP):
                sets = [shingle_set(h[at[j] : at[j + 1]], n) for j in range(i, min(i + STEP, batch.num_rows))]
                yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "s"])

    return run


class Tile:
    """Members of a bucket, indexed by their shingles."""

    def __init__(self, sets: list[np.ndarray], reps: np.ndarray, comps: np.ndarray):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.reps, self.comps = reps, comps
        h = np.concatenate(sets)
        order = np.argsort(h, kind="stable")
        self.h, self.member = h[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def links(self, s: np.ndarray, comp: int, percent: int) -> np.ndarray:
        """The reps of members of other components that are as similar to the set s as asked."""
        low, high = np.searchsorted(self.h, s, "left"), np.searchsorted(self.h, s, "right")
        counts = high - low
        places = np.arange(int(counts.sum())) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        shared = np.bincount(self.member[places], minlength=len(self.sizes))
        return self.reps[(100 * shared >= percent * (len(s) + self.sizes - shared)) & (self.comps != comp)]


def _compare(percent: int):
    """Links (u, v) among rows in the order of tiles, in each of them members (kind 0) before those compared with them."""

    def run(batches):
        now, tile, held = None, None, []
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("chunk").to_pylist()))
            kinds, reps, comps = (batch.column(c).to_numpy() for c in ("kind", "rep", "comp"))
            values, at = batch.column("s").flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column("s")).to_numpy())))
            u, v = [], []
            for i in range(batch.num_rows):
                if keys[i] != now:
                    now, tile, held = keys[i], None, []
                s = values[at[i] : at[i + 1]]
                if kinds[i] == 0:
                    held.append((s, reps[i], comps[i]))
                elif held:
                    if tile is None:
                        tile = Tile([x[0] for x in held], np.array([x[1] for x in held]), np.array([x[2] for x in held]))
                    found = tile.links(s, comps[i], percent)
                    u += [reps[i]] * len(found)
                    v += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _links_of_centres(state: DataFrame, texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between each bucket's most central member and the others. Signatures decide which pairs are compared on full sets."""
    centres = state.groupBy("key").agg(F.max(F.struct("score", "digest")).alias("c")).select("key", F.col("c.digest").alias("b"))
    pairs = state.join(centres, "key").filter("digest <> b").select(F.col("digest").alias("a"), "b").distinct()
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("digest").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("rep").alias(f"rep_{x}")), x)
    pairs = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    likely = saved(pairs.filter(agree >= int((percent / 100 - SLACK) * HASHES)).select("a", "b", "rep_a", "rep_b"), "likely", small=True)
    full = likely.join(sets.select(F.col("digest").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("digest").alias("b"), F.col("s").alias("s_b")), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    links = saved(full.filter(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")), "links", small=True)
    discard(likely)
    return links


def _open(state: DataFrame) -> DataFrame:
    """Rows of buckets with several components."""
    return state.join(state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key"), "key", "left_semi")


def _links_of_rest(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members (key, digest, rep, comp, n) of different components in the same bucket."""
    # two hashes stand for the digest, as minima of longs are quick
    pair = F.xxhash64("digest").alias("x"), F.xxhash64("digest", F.lit(1)).alias("y")
    lone = rest.select("digest").distinct().join(sets, "digest").select(*pair, F.explode("s").alias("h"))
    lone = lone.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("x"), F.min("y").alias("y")).filter("k = 1").groupBy("x", "y").agg(F.count(F.lit(1)).alias("lone"))
    # A pair of n and m shingles must share percent / (100 + percent) of n + m: more than either holds that any other open text has can't be.
    fewest = rest.groupBy("key").agg(F.min("n").alias("fewest"))
    reach = rest.join(fewest, "key").select("*", *pair).join(lone, ["x", "y"], "left").withColumn("reach", F.col("n") - F.coalesce("lone", F.lit(0)))
    able = reach.filter(100 * percent * F.col("n") + percent * F.greatest(100 * F.col("fewest"), percent * F.col("n")) <= 100 * (100 + percent) * F.col("reach"))
    able = saved(_open(able.select("key", "digest", "rep", "comp", "n")), "open", small=True)
    largest = able.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("most"), F.ceil(F.sum("size") / TILE).alias("chunks"))
    able = able.join(largest, "key")
    columns = ["key", "digest", "rep", "comp"]
    members = able.select(*columns, F.pmod(F.xxhash64("digest"), F.col("chunks")).alias("chunk"), F.lit(0).alias("kind"))
    asking = able.filter(F.col("comp") != F.col("most.comp")).select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"))
    tiles = members.unionByName(asking).join(sets, "digest").select("key", "chunk", "kind", "rep", "comp", "s")
    return saved(in_python(tiles.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "kind"), _compare(percent), "u long, v long").distinct(), "links", small=True)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Each row's doc_id, n_shingles, component_id and kept (it is its component's smallest doc_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = saved(in_python(docs, _sketches(n), "doc_id long, n_shingles long, digest binary, sig array<tinyint>, bands array<long>"), "sketches")
    known = sketches.filter("doc_id is not null and digest is not null")
    # A class of texts with equal sets goes by the smallest doc_id that has one of them.
    classes = saved(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), (F.max("doc_id") > F.min("doc_id")).alias("shared"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")

    members = classes.select("digest", "rep", "n", F.explode("bands").alias("key"))
    buckets = saved(members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets", small=True)
    members = saved(members.join(bounded(buckets, 40 * buckets.count()), "key"), "members")
    score = members.groupBy("digest").agg(F.sum("m").alias("score"))
    # Buckets with the same members say the same: one of them is enough, told by an order-free digest.
    same = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("x"))
    chosen = same.groupBy("n", "h", "x").agg(F.min("key").alias("key")).select("key")
    state = saved(members.join(chosen, "key", "left_semi").join(score, "digest").select("key", "digest", "rep", "n", "score"), "members")
    texts = saved(classes.join(state.select("digest").distinct(), "digest", "left_semi").select("digest", "rep", "n", "sig"), "texts", small=True)
    wanted = bounded(texts.select("rep").distinct(), 32 * texts.count())
    sets = saved(in_python(docs.join(wanted, docs["doc_id"] == wanted["rep"], "left_semi"), _sets(n), "digest binary, s array<long>").dropDuplicates(["digest"]), "sets")

    links = _links_of_centres(state, texts, sets, percent)
    found = saved(connected_components(links), "components", small=True)
    comp = found.select(F.col("id").alias("rep"), F.col("component").alias("comp"))
    rest = saved(_open(state.join(comp, "rep", "left").select("key", "digest", "rep", "n", F.coalesce("comp", "rep").alias("comp"))), "rest", small=True)
    more = _links_of_rest(rest, sets, percent)
    # The texts of a doc_id with several belong together.
    text = F.xxhash64("digest")
    several = saved(sketches.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).filter("lo <> hi").select("doc_id"), "several", small=True)
    together = known.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).filter("u <> v")
    more = saved(more.unionByName(together), "links", small=True)
    if not more.isEmpty():
        found = saved(connected_components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)), "components", small=True)
    named = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").filter("shared or component is not null").select("digest", F.coalesce("component", "rep").alias("component"))
    named = saved(named, "named", small=True)
    by_id = saved(several.join(found, several["doc_id"] == found["id"]).select("doc_id", F.col("component").alias("by_id")), "named", small=True)
    for x in (classes, buckets, members, state, texts, sets, links, rest, more, found, several):
        discard(x)
    out = sketches.select("doc_id", "n_shingles", "digest").join(bounded(named, 100 * named.count()), "digest", "left").join(bounded(by_id, 32 * by_id.count()), "doc_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("by_id", "component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows with a null doc_id stay."""
    dropped = saved(near_duplicates(docs, n, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct(), "dropped", small=True)
    return docs.join(bounded(dropped, 32 * dropped.count()), docs["doc_id"].cast("long") == dropped["_dropped"], "left_anti")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)
