"""Cases of single operators: long texts, appended and odd archives, open buckets, unclosed markup, clashing columns, empty tables, and the pipeline's stages."""

import gzip
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from treeline.llm import op1_quality, op2_trie, op3_warc, op4_minhash, op5_html, op6_bpe, op7_mixing, op8_chat, op9_language, op10_graph
from treeline.llm.common import fresh_path
from treeline.llm.eliasfano import EliasFano
from treeline.llm.registry import ORACLES

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_labels(scores, first, penalty):
    out = []
    for a, b in zip(first, first[1:]):
        v, back = scores[a].astype(float) if a < b else None, []
        for s in scores[a + 1 : b]:
            best, top = int(v.argmax()), v.max() - penalty
            back.append((v < top, best))
            v = np.where(v < top, top, v) + s
        if a < b:
            path = [int(v.argmax())]
            for moved, best in reversed(back):
                path.append(best if moved[path[-1]] else path[-1])
            out += path[::-1]
    return out


@pytest.mark.parametrize("segment", [1, 3, 128])
def test_paths_by_segments_are_those_word_by_word(monkeypatch, segment):
    monkeypatch.setattr(op9_language, "SEGMENT", segment)
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        sizes = rng.integers(0, 300, 9)
        first = np.concatenate(([0], np.cumsum(sizes)))
        scores = -rng.exponential(3, (int(first[-1]), n)).astype(np.float32)
        assert op9_language.viterbi(scores, first, 4.0).tolist() == plain_labels(scores, first, 4.0)


def test_a_long_text_takes_no_step_for_each_word():
    scores = -np.random.default_rng(1).exponential(3, (1_000_000, 4)).astype(np.float32)
    began = time.time()
    op9_language.viterbi(scores, np.array([0, len(scores)]))
    assert time.time() - began < 10


def test_language_of_hard_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op9_language.fit(docs)
    long_ = " ".join(r["text"] for r in docs.filter("lang = 'fr'").limit(40).collect()) * 5
    rows = [(1, None, "x"), (1, "", "y"), (None, long_, "z"), (2, "12 34 !!", None), (2, "12 34 !!", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = Counter((r["doc_id"], r["lang_pred"]) for r in op9_language.identify(odd, model).collect())
    assert got == Counter({(1, "und"): 2, (2, "und"): 2, (None, "fr"): 1})


def test_elias_fano_neighbours_and_gaps():
    rng = np.random.default_rng(2)
    for v in (np.sort(rng.integers(0, 50, 3000)), np.cumsum(rng.integers(0, 10**6, 2000)), np.array([0]), np.array([7, 7, 7])):
        e = EliasFano(EliasFano.build(v))
        here, after = e.access_two(np.arange(len(v) - 1))
        assert (here == v[:-1]).all() and (after == v[1:]).all()


def test_trie_finds_the_same_in_any_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    spec = op2_trie.train(docs)
    once = {r["doc_id"]: r["score"] for r in op2_trie.score_documents(docs.coalesce(1), spec).collect()}
    again = {r["doc_id"]: r["score"] for r in op2_trie.score_documents(docs.repartition(7), spec).collect()}
    assert once == pytest.approx(again, abs=1e-9)


def test_a_frequent_word_is_split_over_shards(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    score = lambda spec: {r["doc_id"]: r["score"] for r in op2_trie.score_documents(docs, spec).collect()}
    whole = op2_trie.train(docs)
    monkeypatch.setattr(op2_trie, "SHARD_TOKENS", 60)
    split = op2_trie.train(docs)
    n = sum(p[0] for p in split["parts"]) + 1
    words = [int(c) // n for c in split["cuts"]]
    assert len(whole["shards"]) == 1 and max(map(words.count, words)) > 3 and words.count(n - 1) > 1
    assert score(split) == pytest.approx(score(whole), abs=1e-9)


def exact_components(texts, n):
    sets = {d: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for d, w in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("tile", [1 << 18, 300])
def test_near_duplicates_where_centres_do_not_settle_buckets(spark, monkeypatch, tile):
    monkeypatch.setattr(op4_minhash, "TILE", tile)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(140)]
    texts = {}
    for d in range(1, 150):  # edits of one text, few and many, on few places so that copies share them
        w = list(base)
        for at in rng.choice(40, rng.integers(0, 12), replace=False):
            w[3 * at] = f"e{rng.integers(0, 3)}"
        texts[d] = w
    for d in range(150, 170):  # a chain of small steps
        texts[d] = [f"c{i + 4 * (d - 150)}" for i in range(120)]
    expected = exact_components(texts, 4)
    got = op4_minhash.near_duplicates(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(3), 4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert len(set(expected.values())) > 5


def test_a_tile_counts_intersections():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 35))) for _ in range(30)]
    tile = op4_minhash.Tile(sets, np.arange(30), np.arange(30) % 3)
    for i, s in enumerate(sets):
        near = [j for j, t in enumerate(sets) if j % 3 != i % 3 and 100 * len(np.intersect1d(s, t)) >= 60 * len(np.union1d(s, t))]
        assert tile.links(s, i % 3, 60).tolist() == near


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "k", "v") for r in rows], "doc_id long, text string, component string, rep string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in op4_minhash.near_duplicates(docs).collect())
    assert got == Counter({(None, None, True): 2, (3, 3, True): 1, (4, 4, True): 2, (5, 5, True): 1})
    assert op4_minhash.drop_near_duplicates(docs).columns == docs.columns
    assert op4_minhash.drop_near_duplicates(docs.limit(0)).count() == op4_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_warc_append_keeps_and_overwrite_replaces(spark):
    path = fresh_path(spark, "warc")
    page = lambda i: spark.createDataFrame([(i, "u", "x" * 200, "k")], "page_id long, url string, html string, digest string")
    op3_warc.write_archives(page(1), path)
    op3_warc.write_archives(page(2), path)
    read = lambda: sorted(r["page_id"] for r in spark.read.format("warc").load(path).collect())
    assert read() == [1, 2]
    rows = spark.createDataFrame([(3, "u", "y", "d", None)], "page_id long, url string, html string, digest string, response_id long")
    rows.write.format("warc").mode("overwrite").save(path)
    assert read() == [3]


def test_warc_members_of_several_records(spark, tmp_path):
    record = lambda kind, body, name="WARC-Type": b"WARC/1.0\r\n" + name.encode() + b": " + kind + b"\r\ncontent-length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    big = bytes(np.random.default_rng(0).integers(0, 256, 300_000, dtype=np.uint8))
    bodies = [b"one", big, b"", b"four"]
    whole = b"".join(record(k, b, n) for k, b, n in zip((b"resource", b"metadata", b"resource", b"resource"), bodies, ("WARC-Type", "warc-type", "Warc-Type", "WARC-TYPE")))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(record(b"resource", b"five")))
    (tmp_path / "b.warc").write_bytes(whole + b"WARC/1.0\r\nWARC-Type: resource\r\n")  # cut off within its headers
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert Counter(bytes(r["payload"]) for r in got) == Counter(bodies + bodies + [b"five"])
    assert Counter(r["record_type"] for r in got) == {"resource": 7, "metadata": 2}
    some = spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'metadata'").select("payload").collect()
    assert [bytes(r["payload"]) for r in some] == [big, big]


def test_warc_query_of_an_empty_table_and_its_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert op3_warc.op3_warc(spark, str(tmp_path)).count() == 0
    got = sorted(map(tuple, op3_warc.op3_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(con.sql(ORACLES["op3_warc"]).fetchall()) == got


LONG = "A paragraph with a good number of words in it, more than enough to surge and be the main text."


def test_html_keeps_what_stands_between_surge_and_dive(monkeypatch):
    links = "".join(f"<div>{x}</div>" for x in "abcd")
    notice = "<div>All rights are reserved, and this line stands alone.</div>"
    inner = f"<div><h2>T</h2><p>{LONG}</p><p>{LONG}</p></div>"
    cases = {f"<body>{notice}{links}{inner}{links}{notice}</body>": f"T\n\n{LONG}\n\n{LONG}", f"<body>{notice}{links}<p>{LONG}<p>{LONG}{links}{notice}</body>": f"c\n\nd\n\n{LONG}\n\n{LONG}"}
    for page, text in cases.items():
        assert op5_html.main_text(page) == text
    monkeypatch.setattr(op5_html, "core", lambda lines: (0, len(lines)))
    for page, text in cases.items():
        assert op5_html.main_text(page) != text


def test_html_core_is_the_heaviest_stretch():
    rng = np.random.default_rng(3)
    for _ in range(300):
        sizes = rng.choice([0, 0, 5, 9, 30, 90], rng.integers(0, 16)).tolist()
        window = [sum(sizes[i : i + op5_html.WINDOW]) for i in range(len(sizes))]
        stretches, end = [], 0
        for i in range(len(sizes)):
            if i >= end and sizes[i] and window[i] >= op5_html.SURGE:
                end = next((k for k in range(i, len(sizes)) if window[k] < op5_html.DIVE), len(sizes))
                stretches.append((i, end))
        best = max(stretches, key=lambda x: (sum(sizes[slice(*x)]), -x[0]), default=(0, len(sizes)) if any(sizes) else (0, 0))
        assert op5_html.core([("x" * n, 0, 0.0) for n in sizes]) == best


@pytest.mark.parametrize("page", ["<a '" * 1_000_000, "<!a " * 1_000_000, "<div>a" * 400_000, "<a '>" * 500_000, "<div><section>a</div>" * 100_000, "<script" * 300_000, "<" * 2_000_000])
def test_html_takes_time_in_proportion(page):
    began = time.time()
    op5_html.main_text(page)
    assert time.time() - began < 20


def test_html_of_odd_rows(spark):
    rows = [(1, "u", None, 7), (1, "u", None, 7), (None, None, f"<article><p>{LONG}</article>", 7), (2, "v", "", 7)]
    got = op5_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert Counter(map(tuple, got)) == Counter({(1, "u", "", 0): 2, (None, None, LONG, len(LONG)): 1, (2, "v", "", 0): 1})
    assert op5_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mix_draws_what_the_tree_deals(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sized = op7_mixing._with_sizes(docs)
    planned = op7_mixing.plan(sized, shard_words=300)
    shards = len(planned.first()["_starts"])
    assert shards > op7_mixing.LEVEL  # both levels of the lookup are used
    for r in op7_mixing.with_copies(sized, planned).collect():
        starts, quota = r["_starts"], r["_quota"]
        drawn = [t for t in range(r["_passes"] + 1) if t * r["_blocks"] + r["_block"] < quota and not (r["_block"] == r["_cut_block"] and t == r["_passes"] and r["_hash"] not in r["_cut_hashes"])]
        assert [c["shard"] for c in r["_copies"]] == [int(np.searchsorted(starts, t * r["_blocks"] + r["_block"], "right")) - 1 for t in drawn if r["_size"]]


def test_chat_keeps_long_texts_and_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0, "user", "q", 1), (1, 1, "assistant", None, 1), (None, 0, None, None, 1), (2, 0, "user", "a", 1), (2, 0, "user", "a", 1)], "conv_id long, turn long, role string, text string, m int")
    long_ = rows.filter("conv_id = 1").select(F.lit(9).cast("long").alias("conv_id"), "turn", "role", F.repeat(F.lit("<|x&"), F.lit(5_600_000)).alias("text"), "m")
    both = rows.unionByName(long_).drop("m").withColumn("record", F.lit("clash"))
    back = op8_chat.read_back(op8_chat.formatted(op8_chat.canonical(op8_chat.as_records(both))))
    got = {r["conv_id"]: (r["n"], r["chars"], r["loss"]) for r in back.select("conv_id", F.size("turns").alias("n"), F.aggregate("turns", F.lit(0), lambda a, t: a + F.char_length(t["text"])).alias("chars"), F.char_length("loss").alias("loss")).collect()}
    assert got == {1: (2, 1, 0), None: (1, 0, 0), 2: (2, 2, 0), 9: (2, 44_800_000, 22_400_000)}
    assert op8_chat.formatted(op8_chat.canonical(op8_chat.as_records(rows.limit(0)))).count() == 0


def test_every_vector_can_be_reached():
    rng = np.random.default_rng(4)
    for n in (150, 2000):  # one vector near the centre covers all others
        x = rng.normal(0, 1, (n, 48))
        x = np.concatenate((np.zeros((1, 48)) + 1e-3, x / np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)
        g = op10_graph.Graph.build(x)
        reached, now = {g.start}, [g.start]
        while now:
            now = [int(j) for i in now for j in g.edges[i] if j >= 0 and j not in reached and not reached.add(int(j))]
        assert len(reached) == len(x)


def test_neighbours_over_several_shards_of_real_size(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (200, 16))
    n = 3 * op10_graph.SHARD
    x = (centres[rng.integers(0, 200, n)] + rng.normal(0, 0.4, (n, 16))).astype(np.float32)
    import pandas as pd

    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist(), "dim": 0, "path": "clash"}))
    asked = np.arange(0, n, 400)
    index = op10_graph.build_index(vectors)
    assert index.count() == 3
    got = {}
    for r in op10_graph.nearest(vectors.filter("vec_id % 400 = 0").select(vectors["vec_id"].alias("query_id"), "embedding"), index).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in asked:
        d = ((x - x[q]).astype(np.float64) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / (10 * len(asked)) >= 0.9


def test_estimates_come_near_the_exact_minimum_determinant(spark):
    """Of a small group, the exact estimate's subset (least determinant of all of its size) gives about the same distances."""
    import itertools

    rng = np.random.default_rng(12)
    dims = op1_quality.DIMS
    x = np.round(rng.normal(0, 300, (13, dims))).astype(int)
    x[10:] += 4000  # outliers
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "gid string, " + ", ".join(f"{c} long" for c in op1_quality._X))
    r = op1_quality.estimates(rows).first()
    floor = np.diag([(f * op1_quality.SCALE) ** 2 for f in op1_quality.FLOOR])
    keep = min(itertools.combinations(range(13), 10), key=lambda k: np.linalg.det(np.cov(x[list(k)].T, bias=True) + floor))
    assert keep == tuple(range(10))
    centre = np.array([r[f"m_{i}"] for i in range(dims)])
    inverse = np.array([[r[f"a_{max(i, j)}_{min(i, j)}"] for j in range(dims)] for i in range(dims)])
    d2 = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
    assert d2[:10].max() < d2[10:].min() / 5
    assert np.abs(centre - x[:10].mean(axis=0)).max() < 300


@pytest.fixture(scope="module")
def odd_docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    first = docs.filter("n_chars between 1500 and 4000").orderBy("doc_id").first()
    rows = [(None, None, None, None, None), (7001, "", None, None, 0), (7002, "12 34", "en", None, 5), tuple(first), (None, first["text"] + " more", first["lang"], None, 9)]
    return docs.unionByName(spark.createDataFrame(rows, DOCUMENTS)).selectExpr("*", "'x' as score", "1L as _row", "'y' as rep").repartition(3).cache()


def test_pipeline_stages(spark, odd_docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        got = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "encoding":
            assert got.count() == docs.count()
            continue
        assert got.columns == docs.columns, name
        got = got.cache()
        after = Counter(r["doc_id"] for r in got.select("doc_id").collect())
        assert set(after) <= set(before) and got.count(), name
        if name != "mixing":
            assert all(after[d] <= before[d] for d in after), name
        docs = got
    assert "text" in docs.columns


def test_fragments_of_many_texts_are_not_held_at_once():
    bpe = op6_bpe.encoder(op6_bpe.default_vocabulary())
    texts = [" ".join(f"word{(i * 7 + k) % 500}" for k in range(1600)) for i in range(256)]
    expected = bpe.encode(texts[:3])
    tracemalloc.start()
    try:
        got = bpe.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[:3] == expected and all(bpe.decode(ids) == text for ids, text in zip(got, texts))
    assert peak < 60 << 20


def test_the_mixing_plan_takes_no_python_workers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs, docs.limit(0)):
        planned = op7_mixing.plan(op7_mixing._with_sizes(rows))
        assert "LocalTableScan" in (shown := planned._jdf.queryExecution().executedPlan().toString()) and "ExistingRDD" not in shown
        assert planned.count() == rows.select("source").distinct().count()
