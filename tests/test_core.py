"""Small fixtures with hand-computed results, and invariants on random inputs."""

import json
import random
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltgrove import config
from siltgrove.functions import distances, text
from siltgrove.operators import agent, bm25, chunking, evaluate, graph, hops, inspect, models, nearest, ranking, stems, tree
from siltgrove.plans import pipeline, queries_search
from siltgrove.sources import corpus, pdf, store


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_normalize_answer(spark):
    for given_, want in (("The  Cat, and a dog!", "cat and dog"), ("U.S.A.", "usa"), ("an-apple", "anapple"), ('A "the" theory', "theory")):
        assert one(spark, text.normalize_answer(F.col("t")), t=given_) == want
    assert spark.createDataFrame([(None,)], "t string").select(text.normalize_answer(F.col("t"))).first()[0] is None


def test_parse_response(spark):
    cases = (("think\nRetrieve: who is X?.", "retrieve", "who is X?"), ("t Answer: Paris. ", "answer", "Paris"), ("Retrieve: a Answer: b", "retrieve", "a Answer: b"), ("none", "answer", "Error"), ("Answer: x Answer: y.", "answer", "y"))
    for response, action, payload in cases:
        p = one(spark, text.parse_response(F.col("r")), r=response)
        assert (p.action, p.payload) == (action, payload)
    assert one(spark, text.parse_response(F.col("r")), r="think\nRetrieve: q").thought == "think"


def test_text_functions(spark):
    assert one(spark, text.plain(F.lit("a &lt;b&gt; <i>c</i>&amp; d"))) == "a c & d"
    assert one(spark, text.short_text(F.lit("a b c d"), 2)) == "a b ..."
    assert one(spark, text.truncated(F.lit("a b c d e f"), 4, 1)) == "a b c\n...\nf"
    assert one(spark, text.id_list(F.sequence(F.lit(1), F.lit(101)))).count("...") == 1
    assert one(spark, text.safe_name(F.lit("a/b:  c. "))) == "a_b_ c"
    assert one(spark, text.history(F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))), F.lit("q"))) == "Conversation history:\nUser: hi\n\nCurrent question: q"
    assert one(spark, text.clean_transcript(F.lit("a{vocalsound} b  L_C_D_"))) == "a b lcd"
    assert one(spark, text.parse_answer(F.lit("so. Answer: . Rome. "))) == "Rome"


def test_pack_keeps_the_order_rule():
    got = chunking.pack("One two. Three four five! Six. a b c, d e f; g h i j k l m n. End now?", 5, chunking.white_tokens)
    assert got == ["One two  Three four five", "a b c", "d e f", "g h i j k l m n", " Six  End now"]
    assert chunking.pack("", 5) == [] and chunking.pack(" . ! ", 5) == []


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (4, "word " * 3000)], "doc_id long, text string")
    rows = chunking.chunks(docs, 100).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows}.keys() == {1, 4}
    assert chunking.token_stats(docs.where("doc_id < 4")).first().total == 2


def test_layered_merge():
    edges = [(1, 0), (3, 2), (2, 1), (4, 0), (5, 4)]
    assert tree.layered_merge(6, edges) == ([6, 6, 7, 7, 6, 6, 8, 8, -1], [0] * 6 + [1, 1, 2])
    assert tree.layered_merge(6, [*edges[:4], (5, 3)])[0] == [6, 6, 7, 7, 6, 7, 8, 8, -1]
    assert tree.layered_merge(1, []) == ([-1], [0])


@pytest.mark.parametrize("m,want", [(39, [39]), (40, [20, 20]), (41, [20, 21]), (79, [39, 20, 20]), (80, [26, 27, 27]), (85, [28, 28, 29]), (119, [39, 20, 20, 20, 20]), (120, [30, 30, 30, 30])])
def test_rebalance(m, want):
    parent, layer = [m] * m + [m + 1, -1], [0] * m + [1, 2]
    tree.rebalance(parent, layer, 40)
    sizes = [sum(p == k for p in parent[:m]) for k in range(m, len(parent)) if layer[k] == 1]
    assert sorted(sizes) == sorted(want) and all(parent[k] == m + 1 for k in range(len(parent)) if layer[k] == 1)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10_000))
def test_tree_invariants(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 5))
    parent, layer, emb = tree.grow(x, 4)
    assert sum(p < 0 for p in parent) == 1 and all(la == 0 for la in layer[:n])
    assert all(layer[p] == layer[c] + 1 for c, p in enumerate(parent) if p >= 0)
    assert len(emb) == len(parent)
    every = sorted(((float(x[u] @ x[v]), u, v) for u in range(n) for v in range(u)), key=lambda e: (-e[0], e[1], e[2]))
    assert tree.layered_merge(n, [(u, v) for _, u, v in every]) == tree.layered_merge(n, [(u, v) for _, u, v in tree.spanning_edges(x)])


def leaves(spark, n, trees=1, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(int(k % trees), k, rng.normal(size=6).tolist()) for k in range(n)], "tree_id int, node_id long, embedding array<double>")


def test_forest_and_buckets_are_sound(spark):
    df = leaves(spark, 90, 3)
    for r in tree.health(tree.forest(df.unionByName(df.limit(5)))).collect():
        assert (r.leaves, r.roots, r.misplaced, r.childless) == (30, 1, 0, 0)
    r = tree.health(tree.bucketed_tree(df, 16)).first()
    assert (r.leaves, r.roots, r.misplaced, r.childless) == (90, 1, 0, 0)
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(50)], "node_id long, embedding array<double>")
    r = tree.health(tree.bucketed_tree(same, 8)).first()
    assert (r.leaves, r.roots, r.misplaced) == (50, 1, 0)
    assert tree.forest(df.where("false")).count() == 0


def test_beam_search(spark):
    df = leaves(spark, 60)
    nodes = tree.forest(df)
    q = df.where("node_id < 5").select(F.col("node_id").alias("query_id"), "tree_id", "embedding")
    flat = tree.beam_search(nodes, tree.edges_of(nodes), q, 4, 0).select("query_id", "rank", "node_id").collect()
    exact = nearest.search(df.withColumnRenamed("node_id", "vec_id"), df.where("node_id < 5").withColumnRenamed("node_id", "vec_id"), 4).select("query_id", "rank", "vec_id").collect()
    assert sorted(map(tuple, flat)) == sorted(map(tuple, exact))
    deep = tree.beam_search(nodes, tree.edges_of(nodes), q, 4)
    assert deep.where("layer = 0").count() == 20 and deep.agg(F.max("layer")).first()[0] > 0
    assert tree.beam_search(nodes.where("false"), tree.edges_of(nodes), q, 4).count() == 0


def test_start_layers(spark):
    rows = [(0, la, k) for la, n in {0: 2000, 1: 494, 2: 108, 3: 20, 4: 5, 5: 2, 6: 1}.items() for k in range(n)]
    df = spark.createDataFrame([(t, la, la * 10_000 + k) for t, la, k in rows], "tree_id int, layer int, node_id long")
    assert [tree.start_layers(df, k).first() and tree.start_layers(df, k).first().start_layer for k in (5, 10, 2001)] == [4, 3, None]


def test_components(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 3), (5, 5), (7, 7), (90, 91), (90, 91)]
    p = list(range(100))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links if e[0] is not None for x in e}


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "cat sat mat"), (1, "cat cat dog"), (2, "dog ran far away")], "doc_id long, text string")
    index = bm25.build(docs)
    ask = lambda q: {r.doc_id: round(r.score, 6) for r in bm25.search(index, spark.createDataFrame([(1, q)], "query_id long, text string"), 5).collect()}
    assert ask("cat") == {0: 0.196860, 1: 0.277493}
    assert ask("dog cat") == {0: 0.196860, 1: 0.474353, 2: 0.172478}
    assert ask("cat cat")[1] == pytest.approx(2 * 0.277493, abs=2e-6)
    assert bm25.search(bm25.build(docs.where("false")), spark.createDataFrame([(1, "cat")], "query_id long, text string"), 5).count() == 0


def test_bm25_of_many_queries(spark, tmp_path, monkeypatch):
    """Blocks of documents give what the join gives, and agent_shots joins no question with its documents' words."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    text_of = lambda n: " ".join(words[min(39, int(rnd.expovariate(0.15)))] for _ in range(n))
    rows = [(k, text_of(rnd.randint(1, 30))) for k in range(300)]
    rows += [(300 + k, rows[k % 7][1]) for k in range(60)] + [(400, None), (401, ""), (402, "?"), (None, "w1 w39"), (5, "w38 w39"), (403, "w0 " * 500)]
    asked = [(k, text_of(rnd.randint(1, 8))) for k in range(80)] + [(80, "w0"), (81, "w0 w0 w1"), (82, "nowhere"), (83, None), (84, rows[0][1]), (7, "w39 w39"), (None, "w3")]
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    got = lambda x: {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in x.where("query_id is not null").collect()}
    for top in (1, 3, 50):
        expected = got(bm25.search(bm25.build(docs), queries, top))
        assert got(bm25.search_texts(docs, queries, top)) == expected
    with monkeypatch.context() as m:
        m.setattr(bm25, "ASKED", 60)
        m.setattr(bm25, "COMMON", 0.5)
        assert got(bm25.search_texts(docs, queries, 50)) == expected
    assert bm25.search_texts(docs.where("false"), queries, 3).count() == 0 == bm25.search_texts(docs, queries.where("false"), 3).count()
    queries.where("text is not null").withColumnRenamed("text", "question").write.parquet(str(tmp_path / "queries.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plans = {}
    keep = queries_search.written
    monkeypatch.setattr(queries_search, "written", lambda df, name: (plans.update({name: df._jdf.queryExecution().toString()}), keep(df, name))[1])
    assert queries_search.agent_shots(spark, str(tmp_path)).count() == 87 - 1
    assert "Join" not in plans["hits"]


def test_blocks_of_documents_share_the_top():
    """Small blocks, whose tops are merged, give what one block gives."""
    rnd = np.random.default_rng(3)
    texts = [[f"w{int(t)}" for t in rnd.zipf(1.4, int(n)) if t < 60] for n in rnd.integers(1, 25, 2000)]
    rows = pa.record_batch({"doc_id": pa.array(rnd.permutation(2000)), "terms": pa.array(texts, pa.list_(pa.string()))})
    lines = sorted({(int(q), f"w{int(t)}") for q, t in zip(rnd.integers(0, 200, 1200), rnd.zipf(1.3, 1200)) if t < 60})
    asked = bm25._asked(pa.table({"query_id": [q for q, _ in lines], "term": [t for _, t in lines], "weight": [1 + int(t[1:]) / 9 for _, t in lines]}))

    def tops(size):
        least, found = np.zeros(len(asked.ids)), {}
        for block in bm25._blocks((rows.slice(at, size) for at in range(0, 2000, size)), asked, 9.0):
            for b in block.found(4, least):
                for q, d, x in zip(*(c.to_pylist() for c in b.columns)):
                    found.setdefault(q, []).append((-round(x, 6), d))
        return {q: sorted(x)[:4] for q, x in found.items()}

    whole = tops(2000)
    postings, bm25.POSTINGS = bm25.POSTINGS, 500
    try:
        assert tops(90) == whole
    finally:
        bm25.POSTINGS = postings


def test_stems():
    for word, want in {"running": "run", "relational": "relat", "happiness": "happi", "skies": "sky", "generously": "generous", "cries": "cri", "hoping": "hope", "hopping": "hop", "agreed": "agre", "knightly": "knight", "by": "by", "say": "say", "ties": "tie", "gas": "gas", "national": "nation"}.items():
        assert stems.english(word) == want, word


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, t, k) for k, t in enumerate("abc", 1)], "query_id long, text string, rank int")
    b = spark.createDataFrame([(1, t, k) for k, t in enumerate("cad", 1)], "query_id long, text string, rank int")
    got = {r.text: round(r.score, 6) for r in ranking.fuse([a, b]).collect()}
    assert got == {"a": 0.032522, "c": 0.032266, "b": 0.016129, "d": 0.015873}
    assert [r.text for r in ranking.fuse([a, b], top=2).orderBy("rank").collect()] == ["a", "c"]


def test_ranking_helpers(spark):
    hits = spark.createDataFrame([(1, 5, 0, 0.5), (1, 5, 0, 0.9), (1, 6, 1, 1.0), (1, 7, 0, 0.9)], "query_id long, node_id long, layer int, score double")
    assert [r.node_id for r in ranking.context(hits, 2).orderBy("rank").collect()] == [5, 7]
    rows = spark.createDataFrame([(k, "a" if k < 20 else "b" if k < 21 else None) for k in range(25)], "id long, label string")
    held = ranking.stratified(rows, "label", "id")
    assert held.count() == 25 and {r.label: r.n for r in held.where("held_out").groupBy("label").agg(F.count("*").alias("n")).collect()} == {"a": 2}
    v = spark.createDataFrame([(2, [1.0]), (1, [1.0]), (3, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ranking.distinct_vectors(v).select("vec_id", "copies").collect()] == [(1, 2)]


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "the quick brown fox"), (2, "a"), (3, "Delhi"), (3, None), (4, "x")], "query_id long, answer string")
    pred = spark.createDataFrame([(1, "quick fox fox"), (2, "the"), (3, "Delhi, India"), (4, None)], "query_id long, prediction string")
    assert {r.query_id: round(r.f1, 6) for r in evaluate.f1(pred, gold).collect()} == {1: 0.666667, 2: 0, 3: 0.666667, 4: 0}
    assert {r.query_id: r.em for r in evaluate.exact_match(pred, gold).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    rates = spark.createDataFrame([(1, "Error"), (2, "Not mentioned"), (3, "Rome"), (4, "Paris, France")], "query_id long, prediction string")
    paris = spark.createDataFrame([(k, "Paris") for k in range(1, 5)], "query_id long, answer string")
    kinds = {r.query_id: r.kind for r in evaluate.answer_kinds(rates, paris).collect()}
    assert kinds == {1: "error", 2: "not_mentioned", 3: "false", 4: "other"}
    assert evaluate.lcs("a b c d".split(), "b x d".split()) == 2
    r = evaluate.rouge_l(pred, gold).where("query_id = 1").first()
    assert round(r.recall, 4) == 0.5
    found = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (2, 1, "p")], "query_id long, rank int, text string")
    docs = spark.createDataFrame([(1, "q")], "query_id long, text string")
    assert {r.k: r.recall for r in evaluate.recall_at(found, docs, 2).collect()} == {1: 0.0, 2: 0.5}
    assert evaluate.evaluate(pred, gold, metrics=["em"]) == {"em": 0.25}
    with pytest.raises(ValueError):
        evaluate.evaluate(pred, gold, metrics=["none"])


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, distances.cosine(a, b)) == pytest.approx(0.8)
    assert [one(spark, f(a, b)) for f in (distances.l1, distances.linf)] == [6.0, 3.0]
    assert one(spark, distances.normalized(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    got = nearest.search(base, base.where("vec_id = 1"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3] and got[2].distance is None
    assert nearest.search(base.where("false"), base, 3).count() == 0
    p = {r.label: r.embedding for r in nearest.prototypes(spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0]), (1, None)], "label int, embedding array<double>"), "label").collect()}
    assert p == {0: [2.0, 4.0]}


def test_inspection(spark):
    nodes = spark.createDataFrame([(0, 1, 0, "a b"), (0, 2, 0, "c"), (0, 3, 1, None), (0, 1, 0, "a b")], "tree_id int, node_id long, layer int, text string")
    edges = spark.createDataFrame([(0, 3, 1), (0, 3, 2), (0, 3, 2)], "tree_id int, parent_id long, child_id long")
    assert {r.layer: r.n for r in inspect.layer_counts(nodes).collect()} == {0: 2, 1: 1}
    r = inspect.child_stats(edges).first()
    assert (r.mean_children, r.least_children, r.most_node) == (2.0, 2, 3)
    assert {r.node_id: r.children for r in inspect.node_report(nodes, edges).collect()} == {1: "", 2: "", 3: "1, 2"}
    assert {r.node_id: r.ancestor_id for r in tree.ancestors(nodes, edges).collect()} == {1: 3, 2: 3}


def test_config(tmp_path):
    assert config.overrides(["--tree_top_k", "7", "--dataset=x", "--rerank"]) == {"tree_top_k": 7, "dataset": "x", "rerank": True}
    with pytest.raises(ValueError):
        config.overrides(["--nonsense", "1"])
    (tmp_path / "c.py").write_text("conf = {'dataset': 'd/e', 'bucket_size': 5}")
    c = config.load(str(tmp_path / "c.py"), ["--tree_builder", "knn"])
    assert config.artefact(c) == "d_e_hashing_summary_knn_bucketed_tree"


def test_sources(spark, tmp_path):
    (tmp_path / "m_corpus.json").write_text(json.dumps([{"title": "T", "text": "body"}, {"title": "U", "body": "other"}]))
    (tmp_path / "m.json").write_text(json.dumps([{"question": "q?", "answer": "A", "answer_aliases": ["B", "A"], "paragraphs": [{"idx": 0, "title": "T", "paragraph_text": "body", "is_supporting": True}, {"idx": 1, "title": "U", "paragraph_text": "n", "is_supporting": False}]}]))
    d = corpus.load(spark, str(tmp_path), "m")
    assert sorted(r.text for r in d["passages"].collect()) == ["T\nbody", "U\nother"]
    g = d["gold"].first()
    assert sorted(g.answers) == ["A", "B"] and g.documents == ["T\nbody"]
    (tmp_path / "w.txt").write_text(json.dumps({"document": ["long " * 6001], "summary": "s"}) + "\n" + json.dumps({"document": ["short"], "summary": "t"}) + "\n")
    assert corpus.load(spark, str(tmp_path), "w")["passages"].count() == 1
    (tmp_path / "q.jsonl").write_text(json.dumps({"meeting_transcripts": [{"speaker": "A", "content": "hi{pause}"}], "general_query_list": [{"query": "what", "answer": "x"}]}))
    assert corpus.load(spark, str(tmp_path), "q")["passages"].first().text == "Speaker: A\nContent: hi"
    with pytest.raises(FileNotFoundError):
        corpus.load(spark, str(tmp_path), "none")


def test_pdf_seam(spark, tmp_path):
    for n in ("b.pdf", "A.PDF", "c.txt"):
        (tmp_path / n).write_bytes(b"%PDF" + n.encode())
    assert [p.rsplit("/", 1)[1] for p in pdf.listing(str(tmp_path), "dir")] == ["A.PDF", "b.pdf"]
    cache = str(tmp_path / "cache")
    first = pdf.parse(pdf.read_bytes(spark, str(tmp_path)), lambda b: [b[4:].decode()], cache)
    assert {r.title: r.chunks for r in first.collect()} == {"b": ["b.pdf"], "A": ["A.PDF"]}
    again = pdf.parse(pdf.read_bytes(spark, str(tmp_path)), lambda b: ["new"], cache)
    assert {r.title: r.chunks for r in again.collect()} == {"b": ["b.pdf"], "A": ["A.PDF"]}
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        pdf.unpack(str(tmp_path / "bad.zip"), str(tmp_path / "out"))
    with tarfile.open(tmp_path / "good.tar", "w") as t:
        t.add(tmp_path / "b.pdf", "x/b.pdf")
    assert pdf.listing(pdf.unpack(str(tmp_path / "good.tar"), str(tmp_path / "out")), "dir_recursive")[0].endswith("x/b.pdf")


def test_store_and_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"The mill of place{k} stands. It lies near river{k}.") for k in range(12)], "doc_id long, text string")
    conf = config.Config(max_retrieval_time=1, tree_top_k=3, hybrid_search=True)
    nodes, edges = pipeline.build(docs, conf)
    store.save_tree(nodes, edges, str(tmp_path / "t"))
    nodes, edges = store.load_tree(spark, str(tmp_path / "t"))
    assert nodes.where("layer = 0").count() == 12 and nodes.where("layer > 0 and text is null").count() == 0
    q = spark.createDataFrame([(1, "Near which river lies place7?"), (2, "What of place3?")], "query_id long, question string")
    found = pipeline.retrieve(nodes, edges, q.withColumnRenamed("question", "text"), conf)
    assert found.where("query_id = 1 and rank = 1").first().text.startswith("The mill of place7")
    answers = pipeline.answer(nodes, edges, q, conf)
    assert {r.query_id for r in answers.collect()} == {1, 2}
    store.save_results(answers, str(tmp_path / "r"), {"conf": conf})
    assert store.load_results(spark, str(tmp_path / "r")).count() == 2 and store.load_results(spark, str(tmp_path / "no")) is None
    assert pipeline.answer(None, None, q, config.Config(no_retrieval=True)).count() == 2
    index = bm25.build(docs)
    store.save_index(index, str(tmp_path / "i"))
    assert store.load_index(spark, str(tmp_path / "i")).docs.count() == 12


def test_agent_rounds(spark):
    class Asker:
        def answer(self, messages):
            question = models.read_turn(messages[-1]["content"])[0]
            turns = sum(m["role"] == "user" and models.read_turn(m["content"])[0] == question for m in messages)
            return "t\nRetrieve: more" if turns < 2 or "never" in question else "t\nAnswer: done."

    q = spark.createDataFrame([(1, "fine"), (2, "never")], "query_id long, question string")
    look = lambda x: x.select("query_id", F.concat(F.lit("doc "), "text").alias("documents"))
    done, rounds = agent.run(q, look, 2, Asker)
    assert {r.query_id: r.answer for r in done.collect()} == {1: "done", 2: "Error"}
    assert {r.query_id: r.n for r in rounds.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 3}
    assert {r.query_id: r.documents for r in agent.final_documents(rounds).collect()} == {1: ["doc fine", "doc more"], 2: ["doc never", "doc more"]}
    # A budget of each question's own, within the common one.
    own = q.withColumn("lookups", F.when(F.col("query_id") == 2, 0))
    done, rounds = agent.run(own, look, 2, Asker)
    assert {r.query_id: r.answer for r in done.collect()} == {1: "done", 2: "Error"}
    assert {r.query_id: r.n for r in rounds.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 1}


def test_prompts():
    said = models.agent_messages("One.\nTwo.", "Why?", 2)
    assert models.read_turn(said[-1]["content"]) == ("Why?", "One.\nTwo.") and not models.turn_is_last(said[-1]["content"])
    assert models.turn_is_last(models.turn("d", "q", 0)) and not models.turn_is_last(models.turn("d", "q", -1))
    shown = [m["content"] for m in said if m["role"] == "assistant"]
    assert any("Retrieve: " in x for x in shown) and shown[-1].rpartition("Answer: ")[2] == "Ida Klee"
    assert not any("Retrieve: " in m["content"] for m in models.example(0))
    assert models.ScriptedReader().answer(said).split("\n")[1].startswith("Retrieve: ")
    assert models.ScriptedReader().answer([*said, {"role": "assistant", "content": "x"}, {"role": "user", "content": models.turn("One.", "Why?", 1)}]).split("\n")[1].startswith("Answer: ")
    assert models.read_turn(models.plain_prompt("d", "q")[-1]["content"]) == ("q", "d")
    with pytest.raises(ValueError):
        models.backend(models.READERS, "none")


def test_questions_go_to_their_documents(spark):
    """Two documents in two partitions, with ids far apart, and questions about the second."""
    docs = spark.createDataFrame([(7, "The mill of Brenn is old. It stands near the river Vara."), (1 << 40, "The tower of Saltau is tall. It stands near the river Olm.")], "doc_id long, text string").repartition(2)
    conf = config.Config(passage_as_tree=True, max_retrieval_time=0, tree_top_k=2)
    nodes, edges = pipeline.build(docs, conf)
    q = spark.createDataFrame([(1, "Near which river does it stand?", 1 << 40), (2, "Near which river does it stand?", 7), (3, "Where?", 99)], "query_id long, question string, doc_id long")
    routed = pipeline.routed(q, docs, conf)
    assert {r.query_id: r.tree_id for r in routed.collect()} == {1: 1, 2: 0, 3: None}
    got = {r.query_id: r.answer for r in pipeline.answer(nodes, edges, routed, conf).collect()}
    assert "Olm" in got[1] and "Vara" in got[2] and got[3] == "Not mentioned"
    assert {r.tree_id for r in pipeline.routed(q, docs, config.Config()).collect()} == {0}


def test_budget_by_hops(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"The mill of place{k} stands. It lies near river{k}.") for k in range(6)], "doc_id long, text string")
    rows = [(k, f"{'who near where' if k % 2 else 'what'} place{k % 6}", 1 + k % 2) for k in range(60)]
    train = spark.createDataFrame(rows, "query_id long, question string, hops int").withColumn("embedding", models.embedding_of(F.col("question")))
    hops.save(hops.train(train, 64, epochs=30)[0], str(tmp_path / "hops"))
    with pytest.raises(ValueError):
        config.Config(max_retrieval_time="auto")
    conf = config.Config(max_retrieval_time="auto", hop_model=str(tmp_path / "hops"), reader="scripted")
    nodes, edges = pipeline.build(docs, conf)
    answers, rounds = pipeline.answered(nodes, edges, spark.createDataFrame([(1, "what place3"), (2, "who near where place5")], "query_id long, question string"), conf)
    assert {r.query_id: r.n for r in rounds.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 2} and answers.count() == 2


def test_content_lists(spark, tmp_path):
    items = [{"type": "text", "text": "Head", "text_level": 1}, {"type": "header", "text": "x"}, {"type": "list", "list_items": ["a &amp; b", "c"]}, {"type": "table", "table_body": "<tr><td>1</td></tr>", "odd": 1}]
    (tmp_path / "a.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "b.json").write_text("not a list")
    got = [(r.item_no, r.text) for r in pdf.content_list(spark, f"{tmp_path}/*.json").orderBy("item_no").collect()]
    assert got == [(0, "# Head"), (2, "a & b\nc"), (3, "1")]


def test_prompted_abstracts():
    seen = []
    model = models.PromptedAbstractor(lambda p: seen.append(p) or "one two three", keywords=True)
    assert model.abstract("text", 2, False) == "one two" and "keyword lists" in seen[0] and seen[0].endswith("text")
    assert "excerpts" in models.PromptedAbstractor(str).prompt("t", 9, True)


def test_engine(spark, tmp_path):
    from siltgrove.engine import Engine

    docs = spark.createDataFrame([(k, f"The mill of place{k} stands near river{k}.") for k in range(5)], "doc_id long, text string")
    e = Engine(spark, config.Config(max_retrieval_time=0, hybrid_search=True)).add(docs)
    e.add(spark.createDataFrame([(4, "other"), (9, "The tower of Saltau is tall.")], "doc_id long, text string"))
    assert "Saltau" in e.ask("How tall is the tower of Saltau?")
    e.save(str(tmp_path / "e"))
    again = Engine.load(spark, str(tmp_path / "e"), e.conf)
    q = spark.createDataFrame([(1, "tower of Saltau")], "query_id long, question string")
    assert again.retrieve(q).where("rank = 1").first().text == "The tower of Saltau is tall." and again.nodes.where("layer = 0").count() == 6
    assert again.score(again.answer(q), spark.createDataFrame([(1, "The tower of Saltau is tall")], "query_id long, answer string"))["em"] == 1.0
    with pytest.raises(ValueError):
        Engine(spark).retrieve(q)


def test_corpora_with_documents(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"context": c * 30, "input": f"q{k}", "answer": "a"}) for k, c in enumerate(("long book one ", "other book two ", "long book one "))))
    b = corpus.load(spark, str(tmp_path), "b")
    ids = {r.query_id: r.doc_id for r in b["queries"].collect()}
    at = sorted(ids)
    assert b["passages"].count() == 2 and ids[at[0]] == ids[at[2]] != ids[at[1]]
    (tmp_path / "n_corpus.json").write_text(json.dumps([{"idx": f"{d}_{p}", "title": d, "text": f"{d} part {p}"} for d in ("x", "y") for p in range(3)]))
    (tmp_path / "n.json").write_text(json.dumps([{"question": "of y?", "answer": "a", "document": {"id": "y"}}, {"question": "of none?", "answer": "a", "document": {"id": "z"}}]))
    n = corpus.load(spark, str(tmp_path), "n")
    texts = {r.doc_id: r.text for r in n["passages"].collect()}
    named = {r.question: r.doc_id for r in n["queries"].collect()}
    assert len(texts) == 2 and "y part 2" in texts[named["of y?"]] and named["of none?"] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    assert evaluate.lcs(a, b) == row[-1]


def test_search_in_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in rng.integers(-2, 3, 3)]) for k in range(120)] + [(500, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for metric in ("cosine", "l1"):
        want = sorted(map(tuple, nearest.search(df, df, 4, metric, False).select("query_id", "rank", "vec_id").collect()))
        with monkeypatch.context() as m:
            m.setattr(nearest, "QUERIES", 10)
            m.setattr(nearest, "TILE", 30)
            assert sorted(map(tuple, nearest.search(df, df, 4, metric, False).select("query_id", "rank", "vec_id").collect())) == want


def test_large_trees_go_through_buckets(spark):
    df = leaves(spark, 200)
    r = tree.health(tree.grown(df, bucket=32, largest=50)).collect()
    assert [(x.leaves, x.roots, x.misplaced, x.childless) for x in r] == [(200, 1, 0, 0)]
    r = tree.health(tree.bucketed_tree(df, 32, knn=4)).first()
    assert (r.leaves, r.roots, r.misplaced, r.childless) == (200, 1, 0, 0)
    same = spark.createDataFrame([(0, k, [1.0, 2.0]) for k in range(90)], "tree_id int, node_id long, embedding array<double>")
    assert tree.partition(same, 16).groupBy("bucket").count().agg(F.max("count")).first()[0] <= 16


def test_models():
    e = models.HashingEmbedder(16).embed(["a b", "", None])
    assert np.allclose(np.linalg.norm(e, axis=1), [1, 0, 0])
    calls = []
    result, error = models.with_retries(lambda: calls.append(1) or 1 / 0, 3, sleep=lambda s: None)
    assert result is None and error.startswith("ZeroDivisionError") and len(calls) == 3
    assert models.KeywordAbstractor().abstract("tree tree rock", 1) == "tree"


def test_streaming_ingest(spark, tmp_path):
    from siltgrove.streaming.ingest import ingest

    spark.createDataFrame([(k, f"word{k}") for k in range(6)], "node_id long, text string").write.parquet(str(tmp_path / "in"))
    parents = spark.createDataFrame([(100, models.HashingEmbedder().embed(["word3"])[0].tolist()), (101, models.HashingEmbedder().embed(["word4"])[0].tolist())], "node_id long, embedding array<double>")
    stream = spark.readStream.schema("node_id long, text string").parquet(str(tmp_path / "in"))
    ingest(stream, parents, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.node_id: r.parent_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 6 and got[3] == 100 and got[4] == 101


def test_catalog_names():
    from siltgrove import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_other_builders(spark, tmp_path):
    df = leaves(spark, 40)
    for shape in (tree.neighbour_tree(df, 2), tree.document_tree(df.withColumn("document_index", (F.col("node_id") % 7).cast("int")))):
        r = tree.health(shape).first()
        assert (r.leaves, r.roots, r.misplaced, r.childless) == (40, 1, 0, 0)
    parent, layer, _ = tree.grow_from_links(np.array([[1.0, 0], [1, 0.1], [0, 1], [0.1, 1]]), [(0, 1), (2, 3)])
    assert sum(p < 0 for p in parent) == 1
    odd = spark.createDataFrame([(0, 1, [1.0, 2.0]), (0, 2, [1.0])], "tree_id int, node_id long, embedding array<double>")
    assert tree.health(tree.forest(odd)).first().roots == 1


def test_command_line(spark, tmp_path, capsys):
    from siltgrove import __main__ as cli

    (tmp_path / "m_corpus.json").write_text(json.dumps([{"title": f"T{k}", "text": f"The mill of place{k} is old."} for k in range(6)]))
    (tmp_path / "m.json").write_text(json.dumps([{"question": "What of place3?", "answer": "The mill of place3 is old"}]))
    base = ["--dataset", "m", "--data_dir", str(tmp_path), "--save_dir", str(tmp_path / "out"), "--log_path", str(tmp_path / "log"), "--max_retrieval_time", "1"]
    assert cli.main(["all", *base]) == 0 and "'em': " in capsys.readouterr().out
    assert cli.main(["ask", "-q", "What of place2?", *base]) == 0 and "place2" in capsys.readouterr().out
    assert cli.main(["inspect", "--layer", "0", *base]) == 0 and "node_id" in capsys.readouterr().out
    assert cli.main(["nothing"]) == 2 and (tmp_path / "log" / "m.log").exists()
    assert cli.history_text([("user", "a")], "b").startswith("Conversation history:\nUser: a")
