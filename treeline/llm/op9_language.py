"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi spans.

A word's script (by its first letter's range) narrows the candidate languages to those whose training text uses it. Each
candidate scores the word by its byte n-grams (hashed, smoothed log frequencies), and the best path of labels through
the words, with a penalty for each switch, marks the spans. The document's language is that of most of its letters, its
score that language's share.

Scale: the model is fitted on a bounded sample (`per_language` documents of each language, expected; by a hash of the
id), its size is languages * orders * buckets whatever the corpus; prediction is a narrow map. Paths are found for
segments of all documents of a batch together, with the state carried from segment to segment, so that one long document
takes no more time than many short ones.

Defined cases: null text, or one without a letter, is `und` with score 0, and so is all text where nothing could be
learned; words of a script that no language uses, or without letters, leave the path as it is; equal scores go to the
language that sorts first; rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import crc_mod, in_python, table
from treeline.llm.tokens import _WHITE, buffers

PER_LANGUAGE = 3000
#: Tasks that count the sample.
FIT_TASKS = 12
ORDERS = (3, 4)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Log units that a change of language must win back.
PENALTY = 8.0
#: A language uses a script that has this share of its training words.
SCRIPT_SHARE = 0.002
#: Bytes of text whose paths are found together, words scored at once, and words in a segment of a path.
BLOCK, WORDS, SEGMENT = 1 << 21, 1 << 16, 128

#: First bytes of UTF-8 sequences by script: Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic, Indic and South-East Asian, kana and CJK, Hangul, other.
_RANGES = ((1, 0x41, 0x5A), (1, 0x61, 0x7A), (1, 0xC3, 0xCA), (2, 0xCD, 0xCF), (3, 0xD0, 0xD3), (4, 0xD4, 0xD7), (5, 0xD8, 0xDF), (6, 0xE0, 0xE1), (7, 0xE3, 0xE9), (8, 0xEA, 0xED), (9, 0xEE, 0xF4))
SCRIPTS = 10
_SCRIPT = np.zeros(256, dtype=np.int8)
for _s, _a, _b in _RANGES:
    _SCRIPT[_a : _b + 1] = _s
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_WHITE] = 32


def _words(data: np.ndarray, offsets: np.ndarray):
    """(start, end) of the words in data, and the index of each row's first one."""
    white = _WHITE[data]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[rows] = True
    after[rows[rows > 0] - 1] = True
    s, e = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    return s, e, np.searchsorted(s, offsets, "left")


def _features(data: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Of padded words (a blank before and after each): for each order, the buckets of all n-grams and the index of each word's first one."""
    lengths = e - s + 2
    at = np.cumsum(lengths) - lengths
    padded = np.full(int(lengths.sum()), 32, dtype=np.uint8)
    inner = np.arange(len(padded)) - np.repeat(at, lengths)
    inside = (inner > 0) & (inner < np.repeat(lengths, lengths) - 1)
    letters = np.zeros(len(data), dtype=bool)
    steps = np.zeros(len(data) + 1, dtype=np.int8)
    steps[s] += 1
    steps[e] -= 1
    letters = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    padded[inside] = _FOLD[data[letters]]
    for n in ORDERS:
        # an n-gram for each place but a word's last n-1; those that would cross its end are cut short to its own
        code = np.zeros(len(padded), dtype=np.uint32)
        for j in range(n):
            shifted = padded[j:]
            code[: len(shifted)] = code[: len(shifted)] * np.uint32(257) + shifted
        yield ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32), at, np.maximum(lengths - n + 1, 1)


def _spread(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places at[i], at[i]+1, ... (counts[i] of each i), and the index of each i's first one."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(first - at, counts), first


def _word_scripts(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The script of each word's first letter; 0 where it has none."""
    script = _SCRIPT[data]
    places = np.flatnonzero(script)
    if not len(places):
        return np.zeros(len(s), np.int8)
    k = np.searchsorted(places, s)
    found = places[np.minimum(k, len(places) - 1)]
    return np.where((k < len(places)) & (found < e), script[found], 0).astype(np.int8)


def _count(languages: list[str]):
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        grams = np.zeros((len(languages), len(ORDERS), BUCKETS), dtype=np.int64)
        scripts = np.zeros((len(languages), SCRIPTS), dtype=np.int64)
        for batch in batches:
            which = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            data, offsets = buffers(batch.column("text"))
            s, e, first = _words(data, offsets)
            if not len(s):
                continue
            every = np.repeat(which, np.diff(first))
            for i in range(0, len(s), WORDS):
                a, b, of = s[i : i + WORDS], e[i : i + WORDS], every[i : i + WORDS]
                d = data[a[0] : b[-1]]
                a, b = a - a[0], b - a[0]
                np.add.at(scripts, (of, _word_scripts(d, a, b)), 1)
                for k, (codes, at, counts) in enumerate(_features(d, a, b)):
                    places, _ = _spread(at, counts)
                    key = np.repeat(of, counts) * BUCKETS + codes[places]
                    grams[:, k, :] += np.bincount(key, minlength=len(languages) * BUCKETS).reshape(len(languages), BUCKETS)
        for i, x in enumerate(languages):
            if scripts[i].any():
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([grams[i].tobytes()], pa.binary()), pa.array([scripts[i].tobytes()], pa.binary())], names=["lang", "grams", "scripts"])

    return run


def _sum(group: pa.Table) -> pa.Table:
    total = lambda c: sum(np.frombuffer(x, dtype=np.int64) for x in group.column(c).to_pylist())
    return pa.table({"lang": group.column("lang").slice(0, 1), "grams": pa.array([total("grams").tobytes()], pa.binary()), "scripts": pa.array([total("scripts").tobytes()], pa.binary())})


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model of rows with text and lang. Of each language about `per_language` rows are used, those whose ids hash lowest."""
    labelled = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return {"languages": []}
    share = F.lit(None)
    for x in languages:
        share = F.when(F.col("lang") == x, F.lit(min(1.0, per_language / counts[x]))).otherwise(share)
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")
    schema = "lang string, grams binary, scripts binary"
    sample = sample.repartition(FIT_TASKS)  # its size is bounded
    rows = in_python(sample, _count(languages), schema).groupBy("lang").applyInArrow(_sum, schema).collect()
    rows = sorted((r for r in rows), key=lambda r: r["lang"])
    grams = np.stack([np.frombuffer(r["grams"], dtype=np.int64).reshape(len(ORDERS), BUCKETS) for r in rows]) if rows else np.zeros((0, len(ORDERS), BUCKETS))
    scripts = np.stack([np.frombuffer(r["scripts"], dtype=np.int64) for r in rows]) if rows else np.zeros((0, SCRIPTS))
    score = np.log(grams + SMOOTHING) - np.log(grams.sum(axis=2, keepdims=True) + SMOOTHING * BUCKETS)
    uses = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE
    return {"languages": [r["lang"] for r in rows], "score": np.ascontiguousarray(score.transpose(1, 2, 0), dtype=np.float32), "uses": uses.T.copy()}


def word_scores(model: dict, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log score of each word for each language, 0 for all where the word says nothing; its script; whether it has an ASCII letter."""
    scores = np.zeros((len(s), len(model["languages"])), dtype=np.float32)
    kinds, letters = np.zeros(len(s), dtype=np.int8), np.zeros(len(s), dtype=bool)
    for i in range(0, len(s), WORDS):
        a, b = s[i : i + WORDS], e[i : i + WORDS]
        d, at = data[a[0] : b[-1]], a[0]
        a, b = a - at, b - at
        out = scores[i : i + WORDS]
        for k, (codes, first, counts) in enumerate(_features(d, a, b)):
            places, begin = _spread(first, counts)
            out += np.add.reduceat(model["score"][k][codes[places]], begin, axis=0)
        kind = _word_scripts(d, a, b)
        out[~model["uses"][kind]] = -1e4
        out[(kind == 0) | ~model["uses"].any(axis=1)[kind]] = 0
        out -= out.max(axis=1, keepdims=True)
        kinds[i : i + WORDS] = kind
        letters[i : i + WORDS] = np.logical_or.reduceat((_SCRIPT[d] == 1) & (d < 128), a)
    return scores, kinds, letters


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The label of each word: the best path of each row's words.

    Rows are cut into segments, all of which go step by step together, however long a row is: what a segment does to any
    state before it is found first, the states are carried from segment to segment, and then paths are traced forward
    and, for each label at a segment's end, back.
    """
    total, n = scores.shape
    rows = np.flatnonzero(np.diff(first))
    if not len(rows):
        return np.zeros(total, dtype=np.int16)
    sizes = np.diff(first)[rows]
    count = -(-sizes // SEGMENT)
    begin = np.cumsum(count) - count  # a row's first segment
    which = np.repeat(np.arange(len(rows)), count)
    place = np.arange(len(which)) - begin[which]
    start = first[:-1][rows][which] + place * SEGMENT
    length = np.minimum(SEGMENT, sizes[which] - place * SEGMENT)

    state = np.zeros((len(which), n))  # before each segment
    inner = np.flatnonzero(place < count[which] - 1)  # whole segments with one behind them
    if len(inner):
        best = np.where(np.eye(n, dtype=bool), 0.0, -penalty) + scores[start[inner]][:, None, :]
        for t in range(1, SEGMENT):
            np.maximum(best, best.max(axis=2, keepdims=True) - penalty, out=best)
            best += scores[start[inner] + t][:, None, :]
        at = np.cumsum(place < count[which] - 1) - 1
        for k in range(1, int(count.max())):
            now = begin[count > k] + k
            state[now] = (state[now - 1][:, :, None] + best[at[now - 1]]).max(axis=1)
            state[now] -= state[now].max(axis=1, keepdims=True)

    order = np.argsort(-length, kind="stable")
    start, length, v = start[order], length[order], state[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), "left")  # segments with more than t words
    switched, origin = np.zeros((total, n), dtype=bool), np.zeros(total, dtype=np.int16)
    last = np.zeros(len(order), dtype=np.int16)
    for t in range(steps):
        k = active[t]
        last[k : len(v)] = v[k:].argmax(axis=1)
        v = v[:k]
        best = v.argmax(axis=1)
        top = v[np.arange(k), best] - penalty
        at = start[:k] + t
        lower = v < top[:, None]
        switched[at], origin[at] = lower, best
        v = np.where(lower, top[:, None], v) + scores[at]
    last[: len(v)] = v.argmax(axis=1)

    every = np.zeros((total, n), dtype=np.int16)  # the label of each word for each label at its segment's end
    now = np.zeros((0, n), dtype=np.int16)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        now = np.concatenate((now, np.tile(np.arange(n, dtype=np.int16), (k - len(now), 1))))
        at = start[:k] + t
        every[at] = now
        now = np.where(np.take_along_axis(switched[at], now.astype(np.int64), 1), origin[at][:, None], now)
    before, end = np.empty_like(now), np.empty(len(order), dtype=np.int16)
    before[order], end[order] = now, last
    for k in range(int(count.max()) - 1, 0, -1):
        now = begin[count > k] + k
        end[now - 1] = before[now, end[now]]
    return every[np.arange(total), np.repeat(end, np.minimum(SEGMENT, sizes[which] - place * SEGMENT))]


def _slices(batch: pa.RecordBatch):
    _, offsets = buffers(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def label_batch(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray, tuple]:
    """(language, score) of each text, and (word starts, ends, index of each text's first word, labels)."""
    data, offsets = buffers(texts)
    s, e, first = _words(data, offsets)
    n, languages = len(texts), model["languages"]
    if not languages or not len(s):
        return ["und"] * n, np.zeros(n), (s, e, first, np.zeros(len(s), np.int16))
    scores, kind, letters = word_scores(model, data, s, e)
    labels = viterbi(scores, first)
    weight = np.where(kind > 0, e - s, 0)
    rows = np.repeat(np.arange(n), np.diff(first))
    share = np.bincount(rows * len(languages) + labels, weights=weight, minlength=n * len(languages)).reshape(n, -1)
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    score = share[np.arange(n), best] / np.maximum(total, 1)
    names = [languages[b] for b in best]
    values = None
    for i in np.flatnonzero(np.bincount(rows, weights=letters, minlength=n) == 0):
        values = values or texts.to_pylist()
        if not any(c.isalpha() for c in values[i] or ""):
            names[i], score[i] = "und", 0.0
        elif total[i] == 0:
            names[i], score[i] = languages[0], 0.0
    return names, score, (s, e, first, labels)


def _predict(model: dict, keep: list[str]):
    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                names, score, _ = label_batch(model, batch.column("text"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_python(docs.select("doc_id", "text"), _predict(model, ["doc_id"]), f"doc_id {kind}, lang_pred string, score double")


def spans(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, and in order the language spans of each text with the byte offsets where they start and end."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                _, offsets = buffers(batch.column("text"))
                _, _, (s, e, first, labels) = label_batch(model, batch.column("text"))
                out = []
                for i in range(batch.num_rows):
                    x = labels[first[i] : first[i + 1]]
                    cuts = np.flatnonzero(np.diff(x)) + 1
                    out.append([{"start": int(s[first[i] + a] - offsets[i]), "end": int(e[first[i] + b - 1] - offsets[i]), "lang": model["languages"][x[a]]} for a, b in zip([0, *cuts], [*cuts, len(x)])] if len(x) and model["languages"] else [])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_python(docs.select("doc_id", "text"), run, f"doc_id {kind}, spans array<struct<start:long,end:long,lang:string>>")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is found, for at least that share of their letters; the model is fitted on docs itself."""
    model = fit(docs)

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                names, score, _ = label_batch(model, batch.column("text"))
                yield batch.filter(pa.array((score >= least) & (np.array(names) != "und")))

    return in_python(docs, run, docs.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    found = identify(docs, fit(docs.filter(~held)))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
