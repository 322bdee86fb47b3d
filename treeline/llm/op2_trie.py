"""Language-model scoring with an Elias-Fano n-gram trie.

The model interpolates trigrams, bigrams and add-one unigrams (Dirichlet smoothing at each order, so that the
probabilities after any context sum to one). Its trie is kept in compact files that every executor memory-maps: level 1
holds the words' hashes, level 2 the successors w of a word v, level 3 the words u that came before v w. A level is one
Elias-Fano sequence: each node's children are stored as ids relative to the node's base, the bases are a second, monotone
sequence (the pointers), and a query looks a child up as the successor of base + id, within its context's range only.
Probabilities and back-off weights are quantised to 16 bits of a log scale.

Scale: the corpus is read twice to count and once to score. Counts are combined in each task and moved as sorted,
compressed blocks; a shard holds the words v of a range that covers about SHARD_TOKENS tokens, and a word more frequent
than that is split by ranges of its successors w, so shards grow in number, not in size. Nothing that a shard keeps needs
another's counts: level three holds c / PRIOR3 + p2, and the count of its context u v comes, at scoring, with the node of
u v, which the token before has looked up. All counts cover the whole corpus. Scoring is a narrow map.

Defined cases: null text is empty and scores its end token only; words that training did not hold get the unigram's
probability of an unseen word; without training rows N and V are 0 and each token's probability is 1; rows are scored one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import crc_mod, fresh_path, in_python, local_file, saved, table, write_file
from treeline.llm.eliasfano import STEP, EliasFano, bundle, load, under, within
from treeline.llm.tokens import buffers, word_hashes

_U = np.uint64
END = _U(0x5851F42D4C957F2D)
#: Weight of the lower order against counts, for bigrams and trigrams.
PRIOR2, PRIOR3 = 1000.0, 60.0
#: Tokens whose n-grams a shard holds, about; entries of a part of the vocabulary; bytes of text counted at once, and scored at once.
SHARD_TOKENS, PART_WORDS, BLOCK, SCORED = 2_000_000, 2_000_000, 6 << 20, 4 << 20
#: What level three keeps, c / PRIOR3 + p2, is below 10 to this power.
TOP = 14
#: Quantised: 65535 steps of this many decades from 0 down.
STEP_SIZE = 16 / 65535


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log10 / -STEP_SIZE), 0, 65535).astype(np.uint16)


def _slices(batch: pa.RecordBatch, size: int = BLOCK):
    _, offsets = buffers(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' tokens, each row's end token included, and the index of each row's first one."""
    h, at = word_hashes(batch.column("text"))
    first = at + np.arange(len(at))
    out = np.full(len(h) + batch.num_rows, END, dtype=_U)
    words = np.ones(len(out), dtype=bool)
    words[first[1:] - 1] = False
    out[words] = h
    return out, first


def _count_words(batches):
    for whole in batches:
        hashes, counts = [], []
        for batch in _slices(whole):
            h, c = np.unique(_tokens(batch)[0], return_counts=True)
            hashes.append(h)
            counts.append(c)
        if not hashes:
            continue
        h, at = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000])], names=["h", "c"])


def _write_words(folder: str):
    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            p = batch.column("part").to_numpy()
            for x in np.unique(p):
                rows = p == x
                parts.setdefault(int(x), []).append((batch.column("h").to_numpy()[rows].view(_U), batch.column("c").to_numpy()[rows]))
        for x, pieces in parts.items():
            h, c = (np.concatenate(y) for y in zip(*pieces))
            order = np.argsort(h)
            h, c = h[order], c[order]
            # relative to the part's first hash, which keeps them below 2**63
            arrays = under("hash", EliasFano.build(h - h[0])) | {"base": h[:1], "count": c}
            path = f"{folder}/words-{x}.bin"
            write_file(path, bundle(arrays))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([int(h[0])], pa.uint64()).cast(pa.int64(), safe=False), pa.array([int(c.sum())], pa.int64()), pa.array([path])], names=["part", "n", "first", "total", "path"])

    return run


class Vocabulary:
    """Level 1: ids of words by their hashes, and their counts. Ids follow the order of hashes."""

    def __init__(self, parts: list[tuple]):
        """parts: (number of words, first hash, path), in order."""
        self.sizes = [p[0] for p in parts]
        self.starts = np.cumsum([0, *self.sizes])
        self.firsts = np.array([p[1] for p in parts], dtype=_U)
        files = [load(local_file(p[2])) for p in parts]
        self.hashes = [within(f, "hash") for f in files]
        self.counts = [f["count"] for f in files]
        self.n = int(self.starts[-1])

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int64)
        part = np.searchsorted(self.firsts, h, "right") - 1
        for p in range(len(self.sizes)):
            rows = np.flatnonzero(part == p) if len(self.sizes) > 1 else np.flatnonzero(part >= 0)
            if len(rows):
                found = self.hashes[p].find(h[rows] - self.firsts[p])
                out[rows] = np.where(found >= 0, found + self.starts[p], -1)
        return out

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids; 0 for -1."""
        out = np.zeros(len(ids), dtype=np.int64)
        part = np.searchsorted(self.starts, ids, "right") - 1
        for p in range(len(self.sizes)):
            rows = np.flatnonzero((part == p) & (ids >= 0))
            out[rows] = self.counts[p][ids[rows] - self.starts[p]]
        return out


_OPEN: dict = {}


def _vocabulary(parts: list[tuple]) -> Vocabulary:
    key = tuple(parts)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Vocabulary(parts)
    return _OPEN[key]


def _sorted_counts(key: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (rows of one or two numbers) in order, and the sums of their counts."""
    if c is None and key.shape[1] == 1:
        k = np.sort(key[:, 0])[:, None]
        c = np.ones(len(k), dtype=np.int64)
    else:
        order = np.argsort(key[:, 0], kind="stable") if key.shape[1] == 1 else np.lexsort((key[:, 1], key[:, 0]))
        k = key[order]
        c = np.ones(len(k), dtype=np.int64) if c is None else c[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return k[first], np.add.reduceat(c, first) if len(first) else c[:0]


def _packed(key: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted keys and counts, bytes of the same weight together, compressed."""
    import zstandard

    delta = key.copy()
    delta[1:, 0] -= key[:-1, 0]
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (*delta.T, c)]
    return len(c).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=n * 8 * (width + 1)), dtype=np.uint8).reshape(width + 1, 8, n)
    columns = [np.ascontiguousarray(x.T).view(_U).ravel() for x in raw]
    columns[0] = np.cumsum(columns[0], dtype=_U)
    return np.stack(columns[:width], axis=1), columns[width].astype(np.int64)


def _contexts(ids: np.ndarray, first: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The words before each token and before those; `begin` stands before a text."""
    v, u = np.empty_like(ids), np.empty_like(ids)
    v[1:], u[2:] = ids[:-1], ids[:-2]
    v[first[:-1]] = begin
    u[first[:-1]] = begin
    second = first[:-1] + 1
    u[second[second < first[1:]]] = begin
    return v, u


def _count_trigrams(parts: list[tuple], cuts: np.ndarray):
    def run(batches):
        words = _vocabulary(parts)
        n = words.n
        for whole in batches:
            for batch in _slices(whole):
                h, first = _tokens(batch)
                w = words.ids(h)
                v, u = _contexts(w, first, n)
                pairs = v.astype(_U) * _U(n + 1) + w.astype(_U)
                shard = np.searchsorted(cuts, pairs, "right") - 1
                order = np.argsort(shard.astype(np.int16 if len(cuts) < 32000 else np.int64), kind="stable")
                bounds = np.searchsorted(shard[order], np.arange(len(cuts) + 1))
                for s in range(len(cuts)):
                    rows = order[bounds[s] : bounds[s + 1]]
                    if len(rows):
                        pair = pairs[rows] - cuts[s]
                        key = (pair * _U(n + 1) + u[rows].astype(_U))[:, None] if _fits(cuts, s, n) else np.stack((pair, u[rows].astype(_U)), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_packed(*_sorted_counts(key, None))], pa.binary())], names=["shard", "block"])

    return run


def _fits(cuts: np.ndarray, s: int, n: int) -> bool:
    """Whether a shard's keys are single numbers."""
    width = (int(cuts[s + 1]) if s + 1 < len(cuts) else (n + 1) ** 2) - int(cuts[s])
    return width * (n + 1) < 2**63


def _write_shards(parts: list[tuple], cuts: np.ndarray, n_tokens: int, n_docs: int, folder: str):
    def shard(s: int, pieces: list) -> str:
        words = _vocabulary(parts)
        n = words.n
        keys, c = _sorted_counts(np.concatenate([k for k, _ in pieces]), np.concatenate([x for _, x in pieces]))
        pieces.clear()
        if keys.shape[1] == 1:
            pair, u = keys[:, 0] // _U(n + 1), (keys[:, 0] % _U(n + 1)).astype(np.int64)
        else:
            pair, u = keys[:, 0], keys[:, 1].astype(np.int64)
        del keys
        at, node = _runs(pair)
        pairs = pair[at] + cuts[s]
        del pair
        c2 = np.add.reduceat(c, at)
        v, w = (pairs // _U(n + 1)).astype(np.int64), (pairs % _U(n + 1)).astype(np.int64)
        cv = np.where(v == n, n_docs, words.count(np.where(v == n, -1, v)))
        p2 = (c2 + PRIOR2 * (words.count(w) + 1) / (n_tokens + n + 1)) / (cv + PRIOR2)
        arrays = _level("two", v - v[0], w, int(v[-1] - v[0]) + 1) | _level("three", node, u, len(pairs))
        arrays |= {"first": v[:1], "p2": _quantised(np.log10(p2)), "b2": _quantised(np.log10(PRIOR3 / (c2 + PRIOR3)))}
        arrays["q3"] = _quantised(np.log10(c / PRIOR3 + p2[node]) - TOP)
        path = f"{folder}/shard-{s}.bin"
        write_file(path, bundle(arrays))
        return path

    def run(batches):
        now, pieces = None, []
        done = []
        for batch in batches:
            for s, block in zip(batch.column("shard").to_pylist(), batch.column("block")):
                if s != now and pieces:
                    done.append((now, shard(now, pieces)))
                    pieces = []
                now = s
                pieces.append(_unpacked(block.as_py(), 1 if _fits(cuts, s, _vocabulary(parts).n) else 2))
                if len(pieces) >= 64:  # combine what has come so far
                    pieces = [_sorted_counts(np.concatenate([k for k, _ in pieces]), np.concatenate([x for _, x in pieces]))]
        if pieces:
            done.append((now, shard(now, pieces)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.string())], names=["shard", "path"])

    return run


def _level(name: str, parent: np.ndarray, child: np.ndarray, n_parents: int) -> dict[str, np.ndarray]:
    """Children relative to their parent's base, and the bases: each node's range is as wide as its largest child id needs."""
    span = np.zeros(n_parents + 1, dtype=np.int64)
    last = np.flatnonzero(np.append(parent[1:] != parent[:-1], True))
    span[parent[last] + 1] = child[last] + 1
    bases = np.cumsum(span)
    return under(f"{name}.bases", EliasFano.build(bases)) | under(f"{name}.children", EliasFano.build(bases[parent] + child))


class Level:
    def __init__(self, arrays: dict, name: str):
        self.bases, self.children = within(arrays, f"{name}.bases"), within(arrays, f"{name}.children")

    def find(self, parents: np.ndarray, which: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The node of each child under parents[which], or -1; parents in order, and children about in that of theirs."""
        base, end = np.zeros(len(parents), dtype=_U), np.zeros(len(parents), dtype=_U)
        known = np.flatnonzero((parents >= 0) & (parents < self.bases.n - 1))
        for i in range(0, len(known), STEP):
            some = known[i : i + STEP]
            base[some], end[some] = self.bases.access_two(parents[some])
        target = base[which] + child.astype(_U)
        inside = np.flatnonzero((child >= 0) & (target < end[which]))
        out = np.full(len(which), -1, dtype=np.int64)
        out[inside] = self.children.find(target[inside])
        return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers begins, and the number of each place's run."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Model:
    def __init__(self, spec: dict):
        self.words = Vocabulary(spec["parts"])
        self.cuts, self.n_tokens, self.n_docs = spec["cuts"], spec["tokens"], spec["docs"]
        self.shards = {}
        for s, path in spec["shards"]:
            f = load(local_file(path))
            self.shards[s] = (int(f["first"][0]), Level(f, "two"), Level(f, "three"), f["p2"], f["b2"], f["q3"])

    def score(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its training count, and the log10 probabilities of the base and of the model."""
        n = self.words.n
        order = np.argsort(h)
        first_of, which = _runs(h[order])
        ids = self.words.ids(h[order][first_of])
        w, c = np.empty(len(h), dtype=np.int64), np.empty(len(h), dtype=np.int64)
        w[order], c[order] = ids[which], self.words.count(ids)[which]
        base = np.log10((c + 1) / (self.n_tokens + n + 1))
        v, u = _contexts(w, first, n)
        rank = np.empty(len(h), dtype=np.int64)  # of the token among the block's, in the order of ids
        rank[order] = which
        key = _contexts(rank, first, len(first_of))[0] * (len(first_of) + 1) + rank
        score = base.copy()
        after = np.zeros(len(w))  # back-off weight of the two-word context that a token ends
        found2 = np.zeros(len(w), dtype=bool)
        found3 = np.zeros(len(w), dtype=bool)
        # Lookups go through each level in its order, once for each distinct context.
        order = np.flatnonzero((v >= 0) & (w >= 0))
        order = order[np.argsort(key[order])]
        bounds = np.append(np.searchsorted(v[order].astype(_U) * _U(n + 1) + w[order].astype(_U), self.cuts), len(order))
        third = np.zeros(len(w))
        for s, (start, two, three, p2, b2, q3) in self.shards.items():
            rows = order[bounds[s] : bounds[s + 1]]
            if not len(rows):
                continue
            begin, pair = _runs(key[rows])
            contexts = v[rows[begin]] - start
            some, which = _runs(contexts)
            node = two.find(contexts[some], which, w[rows[begin]])
            known = node[pair] >= 0
            rows, node = rows[known], node[pair[known]]
            score[rows] = p2[node] * -STEP_SIZE
            after[rows] = b2[node] * -STEP_SIZE
            found2[rows] = True
            begin, which = _runs(node)
            node = three.find(node[begin], which, u[rows])
            rows, node = rows[node >= 0], node[node >= 0]
            third[rows] = TOP + q3[node] * -STEP_SIZE
            found3[rows] = True
        cv = np.where(v == n, self.n_docs, self.words.count(np.where(v == n, -1, v)))
        score += np.where(found2, 0.0, np.log10(PRIOR2 / (cv + PRIOR2)))
        # p3 = (c / PRIOR3 + p2) * PRIOR3 / (count of its context + PRIOR3); without a trigram its first term is p2 alone
        outer = np.zeros(len(w))
        outer[1:] = np.where(found2[:-1], after[:-1], 0.0)
        outer[first[:-1]] = math.log10(PRIOR3 / (self.n_docs + PRIOR3)) if self.n_docs else 0.0
        score = np.where(found3, third, score) + outer
        return c, base, score


_MODELS: dict = {}


def _score(spec: dict):
    def run(batches):
        if spec["folder"] not in _MODELS:
            _MODELS.clear()
            _MODELS[spec["folder"]] = Model(spec)
        model = _MODELS[spec["folder"]]
        for whole in batches:
            for batch in _slices(whole, SCORED):
                h, first = _tokens(batch)
                c, base, score = model.score(h, first)
                total = lambda x: np.add.reduceat(x, first[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(batch.num_rows, spec["tokens"], np.int64)), pa.array(total(base)), pa.array(total(score))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def train(docs: DataFrame) -> dict:
    """Count all rows' texts, write the trie into the shared folder, and return what executors need to open it."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "trie")
    texts = docs.select("text")
    words = saved(in_python(texts, _count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "word-counts")
    total = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(F.col("h") == int(END.astype(np.int64)), F.col("c"))), F.lit(0)).alias("d")).first()
    bits = max(1, math.ceil(math.log2(max(total["n"], 1) / PART_WORDS)) if total["n"] > PART_WORDS else 1)
    parts = words.withColumn("part", F.shiftrightunsigned("h", 64 - bits)).repartition(1 << bits, "part")
    rows = in_python(parts, _write_words(folder), "part long, n long, first long, total long, path string").collect()
    rows = sorted(rows, key=lambda r: r["part"])
    spec = {"folder": folder, "parts": [(r["n"], r["first"] % 2**64, r["path"]) for r in rows], "tokens": total["c"], "docs": total["d"], "shards": [], "cuts": np.zeros(1, _U)}
    if not total["n"]:
        return spec
    spec["cuts"] = cuts = _cuts(words, total)
    counted = in_python(texts, _count_trigrams(spec["parts"], cuts), "shard int, block binary").repartition(len(cuts), "shard").sortWithinPartitions("shard")
    spec["shards"] = [(r["shard"], r["path"]) for r in in_python(counted, _write_shards(spec["parts"], cuts, total["c"], total["d"], folder), "shard int, path string").collect()]
    return spec


def _cuts(words: DataFrame, total) -> np.ndarray:
    """First pairs v * (n + 1) + w of the shards: ranges of words v that cover about SHARD_TOKENS tokens each, and of a word with more, ranges of its successors w. Found from sums over ranges of hashes, a fixed number of them for each shard, and from the words with more, of which there are fewer than shards."""
    n = total["n"]
    if n >= 2**32 - 1:
        raise ValueError("pairs of so many words have no numbers of 64 bits")
    shards = max(1, math.ceil(total["c"] / SHARD_TOKENS))
    fine = min(22, max(8, (64 * shards - 1).bit_length()))
    bucket = F.shiftrightunsigned("h", 64 - fine)
    sums = {r["k"] % 2**fine: (r["n"], r["c"]) for r in words.groupBy(bucket.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()}
    starts = np.concatenate(([0], np.cumsum([sums.get(k, (0, 0))[0] for k in range(1 << fine)])))
    tokens = np.concatenate(([0], np.cumsum([sums.get(k, (0, 0))[1] for k in range(1 << fine)])))
    much = words.filter(F.col("c") > SHARD_TOKENS).select(bucket.alias("k"))
    near = words.withColumn("k", bucket).join(F.broadcast(much.distinct()), "k").select("k", "h", "c").collect()
    hot: dict[int, list] = {}
    for k in {r["k"] % 2**fine for r in near}:
        for place, (_, c) in enumerate(sorted((r["h"] % 2**64, r["c"]) for r in near if r["k"] % 2**fine == k)):
            if c > SHARD_TOKENS:
                hot.setdefault(k, []).append((int(starts[k]) + place, c))

    def pieces(v: int, c: int) -> list[tuple[int, int]]:
        """First pairs of a word with c tokens after it: successors are about as frequent there as elsewhere."""
        many = math.ceil(c / SHARD_TOKENS)
        places = np.searchsorted(tokens, [tokens[-1] * j / many for j in range(1, many)])
        return [(v, 0), *((v, int(w)) for w in np.unique(starts[places]) if 0 < w <= n)]

    cuts, held = [(0, 0)], 0
    for k in range(1 << fine):
        count, c = sums.get(k, (0, 0))
        rest = c - sum(x for _, x in hot.get(k, ()))
        if held and held + rest > SHARD_TOKENS:
            cuts.append((int(starts[k]), 0))
            held = 0
        held += rest
        for v, x in hot.get(k, ()):
            cuts += [*pieces(v, x), (v + 1, 0)]
            held = rest
    if total["d"] > SHARD_TOKENS:  # before each text stands the same context
        cuts += pieces(n, total["d"])
    return np.array(sorted({v * (n + 1) + w for v, w in cuts if v <= n}), dtype=_U)


def score_documents(docs: DataFrame, spec: dict) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_python(docs.select("doc_id", "text"), _score(spec), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 7) == 2
    scored = score_documents(docs, train(docs.filter(~held)))
    return scored.withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
