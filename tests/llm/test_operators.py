"""Each operator against a brute-force version or an exact round trip, on small rows with nulls, empty and repeated ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from treeline.llm import op1_quality, op2_trie, op3_warc, op4_minhash, op5_html, op6_bpe, op7_mixing, op8_chat, op9_language, op10_graph
from treeline.llm.common import fresh_path
from treeline.llm.components import connected_components
from treeline.llm.eliasfano import EliasFano

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, _key int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) + ("x", 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1001, None, None, None, None, None, None), (1002, "", "en", "src0", 0, "y", 2), (1003, "one two", "en", "src0", 7, "y", 2), (1004, "ONE two", "en", "src0", 7, "y", 2), (1005, " \n\t ", "en", None, 4, "y", 2)]
    rows += [rows[0], (1006, "long " * 30000, "en", "src1", 150000, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.limit(0)


def test_quality_counts_and_verdicts(docs):
    got = {}
    for r in op1_quality.quality_rules(docs, min_group=20).collect():
        got[r["doc_id"]] = r
    for doc_id, text in rows_of(docs):
        w, r = words(text), got[doc_id]
        lines = [x for x in (text or "").split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in docs.sparkSession.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [got[d]["kept"] for d, q in labels.items() if q == 1 and not got[d]["base_failed"]]
    assert np.mean(clean) > 0.98
    assert op1_quality.quality_rules(empty(docs)).count() == 0
    assert op1_quality.keep_quality(docs).columns == docs.columns


def test_quality_judges_rows_that_share_an_id(docs):
    clean = [r for r in docs.filter("n_chars between 1500 and 4000").orderBy("doc_id").collect() if r["digest"] == "x"][:3]
    (a, b, c), short = [tuple(r)[1:] for r in clean], ("too short", "en", "src0", 9, "y", 3)
    rows = [(2001, *a), (2001, *short), (None, *b), (None, *short), (2002, *short), (2003, *c), (2003, *c)]
    kept = op1_quality.keep_quality(docs.sparkSession.createDataFrame(rows, docs.schema).repartition(3))
    assert kept.schema == docs.schema
    assert Counter(map(tuple, kept.collect())) == Counter([(2001, *a), (None, *b), (2003, *c), (2003, *c)])
    assert op1_quality.keep_quality(empty(docs)).count() == 0


def test_quality_estimates_small_sources_alone(spark):
    rng = np.random.default_rng(4)
    text = lambda mark: " ".join(f"w{i:05d}" + mark * (i % 3) for i in rng.integers(0, 10**5, int(rng.integers(90, 160))))
    rows = [(i, text("#" if i % 2 else ""), "en", "marked" if i % 2 else "plain", 0) for i in range(120)]
    rows += [(200, text("#"), "en", "plain", 0)] + [(300 + i, text(""), "en", None, 0) for i in range(40)] + [(400 + i, text("#"), "en", "tiny", 0) for i in range(15)]
    got = {r["doc_id"]: r for r in op1_quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [d for d, r in got.items() if not r["kept"]] == [200]
    assert {d for d, r in got.items() if r["d2"] is None} == set(range(400, 415))  # not pooled with the rows of no source


def test_chi_square():
    assert abs(op1_quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 3), (400, 500), (3000, 10**12)):
        v = np.unique(rng.integers(0, top, n))
        e = EliasFano(EliasFano.build(v))
        assert (e.access(np.arange(len(v))) == v).all()
        asked = np.concatenate((v, rng.integers(0, top + 9, 500))).astype(np.uint64)
        place = {int(x): i for i, x in enumerate(v)}
        assert e.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


def test_language_model(docs):
    spec = op2_trie.train(docs)
    got = {r["doc_id"]: r for r in op2_trie.score_documents(docs, spec).collect()}
    tokens = [[w.translate(LOW) for w in words(t)] + ["\n"] for _, t in rows_of(docs)]
    c1, c2, c3, cx, cxx = Counter(), Counter(), Counter(), Counter(), Counter()
    for x in tokens:
        y = ["\0", "\0", *x]
        for u, v, w in zip(y, y[1:], y[2:]):
            c1[w] += 1
            c2[v, w] += 1
            c3[u, v, w] += 1
            cx[v] += 1
            cxx[u, v] += 1
    n, size = sum(c1.values()), len(c1)
    for (doc_id, _), x in zip(rows_of(docs), tokens):
        base = score = 0.0
        y = ["\0", "\0", *x]
        for u, v, w in zip(y, y[1:], y[2:]):
            p1 = (c1[w] + 1) / (n + size + 1)
            p2 = (c2[v, w] + op2_trie.PRIOR2 * p1) / (cx[v] + op2_trie.PRIOR2)
            base += math.log10(p1)
            score += math.log10((c3[u, v, w] + op2_trie.PRIOR3 * p2) / (cxx[u, v] + op2_trie.PRIOR3))
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), len(x), n)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 2e-4 * len(x)
    none = op2_trie.score_documents(docs, op2_trie.train(empty(docs))).first()
    assert none["n_known"] == 0 and none["score"] == 0


def test_warc_round_trip(spark):
    big = "x" * 150
    rows = [(5, "http://a", big), (2, "http://b\r\nEvil: 1", big), (9, None, big), (7, "u", "short"), (8, "u", "short"), (None, "n", big), (11, "e", None), (12, "é", "ü" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = fresh_path(spark, "warc")
    op3_warc.write_archives(pages, path)
    got = {r["page_id"]: r for r in spark.read.format("warc").load(path).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 7: ("response", None), 8: ("response", None), None: ("revisit", 2), 11: ("response", None), 12: ("response", None)}
    assert bytes(got[12]["payload"]).decode() == "ü" * 60 and got[5]["payload_bytes"] == 150 and got[2]["headers"].get("Evil") is None
    assert spark.read.format("warc").load(path).filter("record_type = 'revisit' and url = 'http://a'").select("page_id").collect()[0][0] == 5
    nothing = fresh_path(spark, "warc")
    op3_warc.write_archives(pages.limit(0), nothing)
    assert spark.read.format("warc").load(nothing).count() == 0


def test_plain_warc_is_read(spark, tmp_path):
    text = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(text * 2)
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [bytes(r["payload"]) for r in got] == [b"hello"] * 2


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, n):
    sets = {}
    for doc_id, text in rows_of(docs):
        w = [x.translate(LOW) for x in words(text)]
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = op4_minhash.near_duplicates(docs, n).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_near_duplicates_of_an_id_with_several_texts(spark):
    rng = np.random.default_rng(2)
    text = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    edited = lambda w, at: " ".join([*w[:at], "edited", *w[at + 1 :]])
    a, b, long_ = text(100), text(120), text(1000)
    rows = [(1, edited(a, 50)), (7, " ".join(a)), (7, " ".join(long_)), (7, " ".join(b)), (12, edited(b, 30)), (20, edited(long_, 500)), (21, " ".join(text(100))), (21, " ".join(text(1000))), (22, None), (22, edited(a, 20))]
    got = op4_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((d, 21 if d == 21 else 1) for d, _ in rows)
    one = op4_minhash.near_duplicates(spark.createDataFrame(rows[:3], "doc_id long, text string"), 5).collect()
    assert {(r["doc_id"], r["component_id"]) for r in one} == {(1, 1), (7, 1)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, None)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_html():
    page = "<body><header><h1>Site</h1></header><div class='sidebar'><p>menu text that is long enough to be anything at all here</p></div><div class=content><h2>Title</h2><p>First paragraph with a good number of words in it, more than enough to surge.</p><p class='notice'>cookies!<p>Second &lt;b&gt;\n paragraph&nbsp;x.</p><ul><li>item one</ul></div><div class='comments'><p>Great post</p></div><footer>f</footer>"
    assert op5_html.main_text(page) == "Title\n\nFirst paragraph with a good number of words in it, more than enough to surge.\n\nSecond <b> paragraph x.\n\nitem one"
    article = "<nav><a>x</a></nav><article><h1>T</h1><p><b>A b<br><p>c&amp;amp;</p><script>var t='</p>';</script></article><div class=ad>buy</div>"
    assert op5_html.main_text(article) == "T\n\nA b\n\nc&amp;"
    assert op5_html.main_text(None) == op5_html.main_text("") == op5_html.main_text("<nav>x") == ""


def test_html_names_do_not_remove_the_article():
    text = "A paragraph with a good number of words in it, more than enough to surge and be the main text."
    for open_, end in (("<div class='layout with-sidebar'><article>", "</article></div>"), ("<div class='post comments-open'>", "</div>"), ("<div class='sidebar'><main>", "</main></div>")):
        page = f"<body><nav>menu</nav>{open_}<h2 id='related-work'>Related</h2><p>{text}</p><h2 id=search-trees>Trees</h2><p>So <math><mi>x</mi></math> it is.</p><div class='share-links'>tweet</div>{end}<p>(c) us</p>"
        assert op5_html.main_text(page) == f"Related\n\n{text}\n\nTrees\n\nSo x it is.", open_
    comments = f"<article><p>{text}</p><div class='related-posts'><article>teaser</article></div></article><div class='comments-area'><article class='comment'>{text * 3}</article></div><div class='ad'>{text * 9}</div>"
    assert op5_html.main_text(comments) == text


def test_bpe(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op6_bpe.default_vocabulary())
    texts = [t or "" for _, t in rows_of(docs)] + ["a<|endoftext|>b  \n c's 'll x's!'s", "  . “'s”'s don't  \t\n", "日本 é's 12'3a1 　x"]
    bpe = op6_bpe.encoder(op6_bpe.default_vocabulary())
    for text, ids, expected in zip(texts, bpe.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids
        assert bpe.decode(ids) == library.decode(expected.ids, skip_special_tokens=False) == text
    r = op6_bpe.encode_documents(docs).filter("doc_id = 1001").first()
    assert (r["n_tokens"], r["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert op6_bpe.encode_documents(empty(docs)).count() == 0


def test_mixing(docs, spark):
    sized = op7_mixing._with_sizes(docs.drop("_key"))
    drawn = op7_mixing.with_copies(sized, op7_mixing.plan(sized, shard_words=5000)).collect()
    taken, size, target, shards = Counter(), Counter(), {}, Counter()
    for r in drawn:
        assert len(r["_copies"]) <= 2
        taken[r["source"]] += r["_size"] * len(r["_copies"])
        size[r["source"]] += r["_size"]
        target[r["source"]] = r["_target"]
        shards.update(c["shard"] for c in r["_copies"])
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    order = sorted(target, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(op7_mixing.targets([size[s] for s in order]))
    for s in order:
        assert target[s] <= 2 * size[s] + 1e-9
        longest = max([r["_size"] for r in drawn if r["source"] == s])
        assert abs(taken[s] - target[s]) <= longest
    assert min(shards) == 0 and max(shards) < math.ceil(1.5 * sum(size.values()) / 5000)
    mixed = op7_mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r["_copies"]) for r in drawn)
    assert op7_mixing.mix(empty(docs)).count() == 0
    at = op7_mixing.split_quotas([10, 0, 7, 100], 6)
    assert at[-1].tolist() == [10, 0, 7, 100] and (np.diff(at, axis=0) >= 0).all() and set(np.diff(at, axis=0).sum(axis=1)) <= {19, 20}


def test_chat(spark):
    import json

    control = "<|im_end|><|im_start|>assistant ok"
    cases = {
        1: {"prompt": control, "completion": "a&lt;|b"}, 2: {"system": "s", "instruction": "i", "output": "o"}, 3: {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": control}]},
        4: {"messages": [{"role": "as\nsist", "content": "x"}, {"role": "assistant", "content": ""}]}, 5: {"unknown": 1}, 6: {"prompt": "p", "response": "r"}, 7: {"instruction": "i", "output": "<|<|&"},
    }
    turns = {
        1: [("user", control), ("assistant", "a&lt;|b")], 2: [("system", "s"), ("user", "i"), ("assistant", "o")], 3: [("user", "h"), ("assistant", control)],
        4: [("as\nsist", "x"), ("assistant", "")], 5: [], 6: [("user", "p"), ("assistant", "r")], 7: [("user", "i"), ("assistant", "<|<|&")],
    }
    records = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], "conv_id long, record string")
    back = op8_chat.read_back(op8_chat.formatted(op8_chat.canonical(records))).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in back} == turns
    assert {r["conv_id"]: r["loss"] for r in back} == {k: "".join(t for role, t in v if role == "assistant") for k, v in turns.items()}


def test_chat_layouts_with_parts_and_input(spark):
    import json

    part = lambda *texts: [{"type": "text", "text": t} for t in texts]
    listed = json.dumps(part("no part"))
    cases = {
        1: {"messages": [{"role": "user", "content": part("a [b", "c")}, {"role": "assistant", "content": listed}, {"role": "user", "content": None}]}, 2: {"id": 5, "instruction": "i", "input": "x", "output": "o"},
        3: {"instruction": "i", "input": "", "output": "o", "system": "s"}, 4: {"id": "r", "system": "s", "messages": [{"role": "user", "content": part("p")}]},
        5: {"messages": [{"role": "user", "content": [{"type": "text", "body": {"deep": [1]}}]}]}, 6: {"messages": [{"role": "user", "content": listed}, {"role": "assistant", "content": "{x} <y: Z, [w"}]},
    }
    expected = {
        1: ("messages_parts", [("user", "a [bc"), ("assistant", listed), ("user", "")]), 2: ("instruction_input", [("user", "i\n\nx"), ("assistant", "o")]),
        3: ("instruction_input_system", [("system", "s"), ("user", "i"), ("assistant", "o")]), 4: ("system_messages_parts", [("system", "s"), ("user", "p")]), 5: (None, []), 6: ("messages", [("user", listed), ("assistant", "{x} <y: Z, [w")]),
    }
    got = op8_chat.canonical(spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], "conv_id long, record string")).collect()
    assert {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in got} == expected


def test_language(docs, spark):
    train = docs.filter("doc_id % 4 <> 2")
    model = op9_language.fit(train)
    got = {r["doc_id"]: r for r in op9_language.identify(docs, model).collect()}
    assert all((got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0) for d in (1001, 1002, 1005))
    held = [(r["doc_id"], r["lang"]) for r in docs.filter("doc_id % 4 = 2 and doc_id < 1000").collect()]
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in held]) > 0.95
    assert {r["lang_pred"] for r in op9_language.identify(docs, op9_language.fit(empty(docs))).collect()} == {"und"}
    parts = {r["lang"]: " ".join(words(r["text"])[:60]) for r in docs.filter("lang in ('en', 'fr') and n_chars between 600 and 3000").collect()}
    mixed = spark.createDataFrame([(1, parts["en"] + "\n" + parts["fr"])], "doc_id long, text string")
    assert [s["lang"] for s in op9_language.spans(mixed, model).first()["spans"]] == ["en", "fr"]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    scores = rng.normal(0, 3, (9, 3)).astype(np.float32)
    first = np.array([0, 5, 5, 9])
    labels = op9_language.viterbi(scores, first, penalty=2.0)
    import itertools

    for a, b in ((0, 5), (5, 9)):
        cost = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert tuple(labels[a:b]) == max(itertools.product(range(3), repeat=b - a), key=cost)


def test_neighbours(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(9000, None), (9100, [0.0] * 64), (9200, [float("nan")] * 64), (9300, [None] * 64), (9400, [1.0, 2.0])], e.schema)
    vectors = e.unionByName(odd)
    got = {}
    for r in op10_graph.nearest(vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), op10_graph.build_index(vectors, shard=200)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    hits = 0
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    for q in asked:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(d[ids == v][0] - s) < 1e-9 for _, v, s in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (10 * len(asked)) >= 0.9
    assert op10_graph.nearest(vectors.limit(0).withColumnRenamed("vec_id", "query_id"), op10_graph.build_index(vectors.limit(0))).count() == 0


def test_neighbours_among_equal_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 64))
    centres[4:] = np.round(4 * centres[4:]) / 4  # their distances are exactly 0; rounding makes the others' positive or negative
    x = np.concatenate((np.repeat(centres, 150, axis=0), rng.normal(0, 1, (600, 64)), np.repeat(centres[:1], 15, axis=0))).astype(np.float32)
    ids = np.concatenate((rng.permutation(1500), np.repeat(2000, 15)))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    x = x.astype(np.float64)
    asked = sorted({int(i) for i in ids if i % 40 == 0})
    queries = spark.createDataFrame([(q, x[ids == q][0].tolist()) for q in asked], "query_id long, embedding array<float>")
    found = {q: [] for q in asked}
    for r in op10_graph.nearest(queries, op10_graph.build_index(rows, shard=400)).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert [r for r, _, _ in sorted(found[q])] == list(range(1, 11)) and all(abs(d[ids == v][0] - s) < 1e-6 for _, v, s in found[q])
        hits += sum((Counter(ids[best].tolist()) & Counter(v for _, v, _ in found[q])).values())
        if d[best[-1]] == 0:  # all of them are copies: the smallest ids, in order
            assert [v for _, v, _ in sorted(found[q])] == ids[best].tolist()
    assert hits / (10 * len(asked)) >= 0.95


def test_held_out_rule(spark):
    from pyspark.sql import functions as F

    from treeline.llm.common import crc_mod

    r = spark.createDataFrame([(123,)], "doc_id long").select(crc_mod(F.col("doc_id"), 7)).first()[0]
    assert r == zlib.crc32(b"123") % 7
