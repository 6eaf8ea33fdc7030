"""Operators of the training-data subpackage: defined results for odd input, and comparison with brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltgrove.llm import language, leak, level, markup, mix, mixture, neardup, nearest, pairs, registry, scans, split

WORD = re.compile(r"[^ \t\n\r]+")


# 1: splitting


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab .,!?\n\t;é", max_size=900), st.integers(1, 12), st.integers(1, 40), st.integers(0, 5))
def test_pieces_cover_and_fit(text, words, chars, overlap):
    pieces = split.split_texts([text, "x", text], words, chars, overlap)
    assert pieces[0] == pieces[2] and pieces[1] == ["x"]
    assert all(len(p) <= chars and len(WORD.findall(p)) <= words for p in pieces[0])
    assert all(p == p.strip(" \t\n\r") and p in text for p in pieces[0])
    assert bool(pieces[0]) == bool(WORD.search(text))
    s, e, r = split._words(text, chars)
    if s:
        a, b = split.cuts(np.array(s), np.array(e), np.array(r), np.array([0, len(s)]), words, chars, min(overlap, words - 1))
        assert a[0] == 0 and b[-1] == len(s) - 1
        assert all(0 <= b[k - 1] + 1 - a[k] <= overlap and b[k] > b[k - 1] for k in range(1, len(a)))


def test_split_prefers_sentences():
    text = " ".join(f"Sentence {k} has exactly six words." for k in range(60))
    pieces = split.split_texts([text])[0]
    assert len(pieces) > 2 and all(p.endswith(".") for p in pieces)
    assert all(p.startswith("Sentence") for p in pieces)


def test_split_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n", 9), (4, "short one", 9), (4, "short one", 9), (5, "w " * 300, 9), (6, "x" * 2000, 9), (None, "y " * 130, 9)]
    out = split.split_long(spark.createDataFrame(rows, "id long, text string, chunk_index int"))
    n = Counter(r.id for r in out.collect())
    assert n[1] == n[2] == n[3] == 1 and n[4] == 2 and n[6] == 3 and n[5] >= 3 and n[None] == 2
    assert {r.text for r in out.where("id <= 3").collect()} == {None}
    assert sorted(r.chunk_index for r in out.where("id = 6").collect()) == [0, 1, 2]
    assert split.split_long(out.where("false")).count() == 0


def test_oversized_by_white_space_is_found(spark, tmp_path):
    texts = ["short" + " " * 900, " " * 901, "w " * 130, "short", " " * 900, None]
    spark.createDataFrame([(1, texts)], "sample_id long, document array<string>").write.parquet(f"{tmp_path}/wcep.parquet")
    spark.createDataFrame([(7, 0, "\n" * 950 + "leaf"), (8, 1, "x" * 950)], "node_id long, layer int, text string").write.parquet(f"{tmp_path}/nodes.parquet")
    got = {tuple(r) for r in registry.p1_found(spark, str(tmp_path)).collect()}
    assert got == {("wcep", 1, 0), ("wcep", 1, 1), ("wcep", 1, 2), ("node", 7, -1)}


# 2: scanned text


def content(spark, rows):
    cols = "item_id long, pdf_id long, title string, page_idx int, item_type string, text_level int, text string, content string, words string, heads string"
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], cols)


def test_scans(spark):
    clean = [(100 + k, 1, "The Old Mill", 3, "text", 0, "The mill was between the river and the wind-worn hill. The miller opened the door.", None) for k in range(30)]
    noisy = [
        (1, 1, "The Old Mill", 3, "text", None, "The miller op-\nened the door bet-\n— 3 —\nween the river\nTHE OLD MILL  4\nand the hill.", None),
        (2, 1, "The Old Mill", 3, "other", None, None, "The mi1ler 0pened thc door betwøen the river and the wind-\nworn hill."),
        (3, 1, "The Old Mill", 3, "text", 2, "op-\nened", None),
        (4, 1, None, None, "list", 0, "", None),
        (5, None, None, None, "text", 0, None, None),
        (6, 1, "The Old Mill", 3, "text", 0, "The mill\nwas between\nthe river", None),
        (6, 1, "The Old Mill", 3, "text", 0, "The mill\nwas between\nthe river", None),
        (None, 1, "T", 1, "text", 0, "a\n1\nb", None),
        (7, 1, "The Old Mill", 12, "text", 0, "The mill\nH2O\nwas\n1925\nold", None),
    ]
    out = {(r.item_id, r.field): r for r in scans.repair(content(spark, clean + noisy)).collect()}
    assert out[1, "text"].text == "The miller opened the door between the river and the hill."
    assert out[1, "text"].defects == ["hyphen", "page_number", "running_head"]
    assert out[2, "content"].text == "The miller opened the door between the river and the wind-worn hill."
    assert out[2, "content"].defects == ["misread"]
    assert (3, "text") not in out and out[4, "text"].text == "" and (5, "text") not in out
    assert out[6, "text"].text == "The mill was between the river" and out[6, "text"].defects == []
    assert out[7, "text"].defects == []
    assert all(not r.defects for (i, _), r in out.items() if i >= 100)
    assert scans.repair(content(spark, noisy).where("false")).count() == 0


def test_viterbi_uses_context():
    pairs_ = {("the", "form"): 9, ("form", "of"): 9}
    got = scans.decode(["forrn"], [[("form", np.log(0.02), 10), ("forrn", 0.0, 0)]], "the", "of", pairs_, 1000)
    assert got == ["form"]
    assert scans.decode(["corn"], [[("com", np.log(0.02), 1), ("corn", 0.0, 20)]], None, None, {}, 1000) == ["corn"]
    assert scans.roman("xlix") == 49 and scans.is_page_number("xii", 12) and not scans.is_page_number("mix", 12)


def test_any_number_of_confusions():
    assert "glimmering" in scans.readings("gl1mmer1ng", -40.0) and "wooden" in scans.readings("vv0oden", -40.0)
    assert "willowing" in scans.readings("vv1ll0vv1ng", -40.0) and "willowing" not in scans.readings("vv1ll0vv1ng", -12.0)
    assert "of" in scans.readings("0f", -9.0) and not scans.readings("0f", -1.0)
    assert scans.is_chapter("Chapter IV: " + "of the long way over the hills and down again to the sea and home " * 2)


def test_confusions_are_estimated(spark):
    vocabulary = spark.createDataFrame([("never", 900_000), ("nøver", 9_000), ("corn", 500_000), ("com", 10)], "w string, n long")
    good = spark.createDataFrame([("nøver", 9_000, "never", [0], 900_000), ("com", 10, "corn", [21], 500_000)], "w string, n long, cand string, how array<int>, cn long")
    logs = scans.channel(good, vocabulary)
    assert logs[0] > np.log(0.02) > logs[21] and len(logs) == len(scans.CONFUSIONS)


def test_long_running_heads(spark):
    title = "On the mills and rivers of the northern valleys " * 8
    row = (1, 1, title, 3, "text", 0, f"The mill was old.\n{title}\nThe river was wide.", None)
    got = scans.repair(content(spark, [row])).first()
    assert got.defects == ["running_head"] and got.text == "The mill was old. The river was wide."


# 3: clusters


def nodes(spark, vectors, layer=0, extra=()):
    rows = [(int(k), layer, f"text {k}", [float(x) for x in v], 1, 2, 3) for k, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *extra], "node_id long, layer int, text string, embeddings array<float>, density int, rank int, v int")


def blobs(rng, sizes, noise, width=64, spread=0.03):
    out = [c / np.linalg.norm(c) + rng.normal(size=(n, width)) * spread for n, c in zip(sizes, rng.normal(size=(len(sizes), width)))]
    return np.concatenate([*out, rng.normal(size=(noise, width))])


def brute_clusters(x, least=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T) >= 0.8
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(x))])
        if (new == label).all():
            break
        label = new
    n = Counter(label.tolist())
    return {(k, int(c)) for k, c in enumerate(label) if n[int(c)] >= least}


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = blobs(rng, [60, 40, 9, 5, 4], 60)
    chain = rng.normal(size=64)
    chain = [chain + k * 0.1 * rng.normal(size=64) for k in range(6)]
    x = np.concatenate([x, chain, x[:1], x[:1]]).astype(np.float32)
    odd = [(9001, 0, None, None, 1, 2, 3), (9002, 0, "", [0.0] * 64, 1, 2, 3), (9003, 0, "", [1.0] * 63, 1, 2, 3), (9004, 0, "", [float("nan")] * 64, 1, 2, 3), (9005, 1, "", [float(v) for v in x[0]], 1, 2, 3), (0, 0, "text 0", [float(v) for v in x[0]], 1, 2, 3)]
    df = nodes(spark, x, extra=odd)
    got = {(r.node_id, r.cluster_id) for r in mixture.members(df).collect()}
    assert got == brute_clusters(x.astype(float))
    d = mixture.described(df).collect()
    assert {r.cluster_id for r in d} == {c for _, c in got} and all(1 <= r["rank"] <= 3 and r.text for r in d)
    assert mixture.members(df.where("false")).count() == 0
    assert mixture.members(df.where("node_id < 2")).count() == 0


@pytest.mark.parametrize("sizes", [{"DIVIDE": 60, "PART_SAMPLE": 80}, {"BLOCK": 40}, {"DIVIDE": 60, "PART_SAMPLE": 80, "BLOCK": 16}])
def test_clusters_in_divided_components_and_grids(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(mixture, k, v)
    rng = np.random.default_rng(8)
    x = np.concatenate([blobs(rng, [150, 60, 30, 9, 5, 4], 80), np.tile(rng.normal(size=(1, 64)), (120, 1))]).astype(np.float32)
    got = {(r.node_id, r.cluster_id) for r in mixture.members(nodes(spark, x)).collect()}
    assert got == brute_clusters(x.astype(float))


def test_blocks_grow_with_the_data_where_components_are_divided(spark, monkeypatch):
    """Rows shipped per vector stay the same when there are four times as many, instead of growing with a grid."""
    monkeypatch.setattr(mixture, "DIVIDE", 200)
    monkeypatch.setattr(mixture, "PART_SAMPLE", 200)
    monkeypatch.setattr(mixture, "BLOCK", 400)
    shipped = []
    for times in (1, 4):
        rng = np.random.default_rng(9)
        x = blobs(rng, [80] * (10 * times), 200 * times).astype(np.float32)
        units = mixture.unit_vectors(nodes(spark, x), "node_id", "embeddings", 64)
        model = mixture.fit(units)
        mixture._represent(units, model)
        shipped.append(mixture._belong(units, model).count() / len(x))
    assert shipped[1] < 1.7 * shipped[0]


def test_linked_joins_dense_and_sparse_spots():
    rng = np.random.default_rng(5)
    x = blobs(rng, [700, 300, 6], 40)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(len(x))
    every = np.ones(len(x), bool)
    least = mixture.linked(ids, x, np.full(len(x), -1), every, every)
    assert {(k, int(c)) for k, c in enumerate(least) if (least == c).sum() >= 5} == brute_clusters(x.astype(float))


# 4: pairs

SENTENCES = {
    "en": "The baker opened his shop before dawn. Which road leads to the harbour? She wrote that the winter had been hard and that nobody came. When was the bridge built after the flood? They carried the stones down to the river with two carts. It was said because the wind had turned. Who kept the keys of the tower while the guard slept?",
    "fr": "Le boulanger ouvrait sa boutique avant l'aube. Quelle route mène au port? Elle écrivait que l'hiver avait été dur et que personne ne venait. Quand le pont fut-il construit après la crue? Ils portaient les pierres jusqu'à la rivière avec deux charrettes. On le disait parce que le vent avait tourné. Qui gardait les clés de la tour pendant que le garde dormait?",
    "de": "Der Bäcker öffnete seinen Laden vor der Dämmerung. Welche Straße führt zum Hafen? Sie schrieb, dass der Winter hart gewesen sei und dass niemand kam. Wann wurde die Brücke nach der Flut gebaut? Sie trugen die Steine mit zwei Karren zum Fluss hinunter. Man sagte es, weil der Wind sich gedreht hatte. Wer hielt die Schlüssel des Turms, während die Wache schlief?",
    "it": "Il fornaio apriva la sua bottega prima dell'alba. Quale strada porta al porto? Lei scriveva che l'inverno era stato duro e che nessuno veniva. Quando fu costruito il ponte dopo la piena? Portavano le pietre fino al fiume con due carri. Lo si diceva perché il vento era cambiato. Chi teneva le chiavi della torre mentre la guardia dormiva?",
}


@pytest.fixture(scope="module")
def learned(spark):
    """A model of a log and labels whose wording stands in no list of the package."""
    parts = [(x.strip(), k) for k, t in SENTENCES.items() for x in re.findall(r"[^.?]+[.?]", t)] * 3
    rng = random.Random(4)
    names = ["Anna", "Berg", "Carlo", "Dora"]
    log = [(f"Who met {rng.choice(names)} near the {w}?", f"They say so. {rng.choice(names)} saw the {w} because it was {c}.\nAnswer: {rng.choice(names)} kept the {w}.") for w in ("mill", "tower", "bridge", "harbour", "garden") for c in ("old", "tall", "red", "small", "wide")]
    log += [(f"What is the {w} of Brenn?", "Well.\nAnswer: That lies outside my remit today") for w in ("river", "market", "tower", "street")]
    log += [("Who met Anna near the mill?", "Thus.\nAnswer: Anna was")]
    rows = spark.createDataFrame(log, "prompt string, response string")
    return pairs.fit(rows, spark.createDataFrame(parts, "text string, lang string"))


@pytest.mark.parametrize(
    "prompt,response,want",
    [
        ("Who led it?", None, "empty"), ("Who led it?", "", "empty"), ("Who led it?", "t\nAnswer: \u200b", "empty"), ("Who led it?", "t\nAnswer: \"\"", "empty"),
        ("Who led it?", "Sorry, that lies outside my remit today.", "refusal"), ("Who led it?", "t\nAnswer: We regret that we can't reply to such enquiries.", "refusal"), ("Who led it?", "I would rather abstain from this.", "refusal"),
        ("Qui?", "t\nAnswer: Hélas, je ne saurais répondre à cela", "refusal"), ("Wer?", "Darüber erteile ich keinerlei Auskünfte.", "refusal"), ("Chi?", "t\nAnswer: Mi spiace, non posso fornire tali dati", "refusal"), ("Quién?", "Prefiero no contestar, no estoy autorizado a dar datos.", "refusal"),
        ("Who led the old mill?", "t\nAnswer: Question: WHO LED THE OLD MILL", "copy"), ("Who led the old mill?", "t\nRetrieve: Who led the old mill?", "copy"),
        ("Who led the old mill?", "t\nAnswer: who led the old mill: Anna Berg", None), ("Who led it?", "t\nAnswer: the apology of Anna, who was sorry and unable to pay", None), ("Who led it?", "t\nAnswer: Dora declined to answer and could not help the council", None),
        ("Who led it?", 't\nAnswer: Dora wrote "I cannot answer this request" and left', None),
        ("Who led it?", "The passage says that the mill was old and\nAnsw", "truncated"), ("Who led it?", "t\nAnswer: The mill was led by Anna (who was", "truncated"),
        ("Who led it?", "t\nAnswer: Anna kept it safely becau", "truncated"), ("Who led it?", "t\nAnswer: Anna saw the mill near the", "truncated"), ("Who led it?", "t\nAnswer: Anna sold it and Dora kept the mill", None),
        ("Which road leads to the harbour of Brenn?", "t\nAnswer: Nessuno portava le pietre al ponte prima dell'inverno.", "wrong_language"), ("Which road leads to the harbour?", "t\nAnswer: Personne ne portait les pierres avant l'hiver.", "wrong_language"),
        ("Quelle route mène au port?", "t\nAnswer: Nobody carried the stones before the winter.", "wrong_language"), ("Welche Straße führt zum Hafen?", "t\nAnswer: Niemand trug die Steine vor dem Winter.", None),
        ("Which road leads to the harbour?", "t\nAnswer: Not mentioned", None), ("Who led the mill?", 't\nAnswer: The letter said "Le pain est ici avec nous dans la ville." and Anna kept it.', None), (None, "t\nAnswer: 1924.", None), ("Who?", "x " * 50_000 + "\nAnswer: Anna", None),
    ],
)
def test_defects(learned, prompt, response, want):
    assert pairs.defect(prompt, response, learned) == want


def test_defect_rows(spark):
    rows = [(1, "q", None, "t", "x"), (1, "q", None, "t", "x"), (None, "q", None, "t", "x"), (2, "q?", "t\nAnswer: Rome", "t", "x")]
    df = spark.createDataFrame(rows, "log_id long, subquestion string, response string, thought string, defect string")
    labels = spark.createDataFrame([("a", "en"), (None, "fr"), ("b", None)], "text string, lang string")
    assert [tuple(r) for r in pairs.defects(df).collect()] == [(1, "empty")]
    assert [tuple(r) for r in pairs.defects(df, labels).collect()] == [(1, "empty")]
    assert pairs.defects(df.where("false")).count() == 0


def test_templates_beyond_those_in_memory(spark):
    rng = random.Random(9)
    common = [f"com{k}" for k in range(40)]
    replies = []
    for k in range(pairs.TEMPLATES + 400):
        own = [f"w{k}x{i}" for i in range(rng.randint(5, 9))]
        at = rng.randrange(len(own) + 1)
        replies.append(own[:at] + rng.choices(common, k=rng.choice([0, 3, 12, 30])) + own[at:])
    log = [(f"Who kept mill {k}-{i}?", "t\nAnswer: " + " ".join(t) + ".", "refusal") for k, t in enumerate(replies) for i in range(3)]
    for t in rng.sample(replies, 300):
        k = rng.randrange(len(t))
        log.append(("Who?", "t\nAnswer: so " + " ".join(t) + " and thus.", "refusal"))
        log.append(("Who?", " ".join(t) + ".", "refusal"))
        log.append(("Who?", 't\nAnswer: Dora wrote "' + " ".join(t) + '" and left.', None))
        log.append(("Who?", "t\nAnswer: " + " ".join(t[: len(t) // 2]) + ".", None))
        log.append(("Who?", "t\nAnswer: " + " ".join(t[:k] + t[k + 1 :]) + ".", "either"))
        log.append((" ".join(t) + "?", "t\nAnswer: " + " ".join(t) + ",", "refusal"))
    df = spark.createDataFrame([(n, p, r) for n, (p, r, _) in enumerate(log)], "log_id long, subquestion string, response string")
    got = dict(map(tuple, pairs.defects(df).collect()))
    assert [n for n, (_, _, want) in enumerate(log) if want != "either" and got.get(n) != want] == []
    model = pairs.fit(df.select(F.col("subquestion").alias("prompt"), "response"))
    assert len(model.templates) == len(replies)
    assert [n for n, (p, r, _) in enumerate(log) if got.get(n) != pairs.defect(p, r, model)] == []


def test_languages_of_few_or_no_rows(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert language.fit(none).names == [] and language.fit(none).of_words({"the"}) == 0


# 5: near duplicates


def brute_pairs(texts, permille=600):
    sets = {i: set(map(tuple, (lambda t: zip(t, t[1:], t[2:]))(re.findall(r"[^\W_]+", x.lower())))) for i, x in texts.items()}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 1000 * c >= permille * (len(sets[a]) + len(sets[b]) - c):
                    out.add((a, b))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = {}
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([5, 20, 60]))
        for copy in range(4):
            w = [rng.choice(vocabulary) if rng.random() < 0.04 * copy else x for x in words]
            texts[base * 10 + copy] = " ".join(w)
    texts[500], texts[501] = texts[0].upper(), texts[0] + "!"
    rows = [(i, [t.split(" ", 1)[0], None, "", t.split(" ", 1)[1]], "clash") for i, t in texts.items()]
    rows += [rows[0], (900, None, "c"), (901, [], "c"), (902, [None, ""], "c"), (903, ["two words"], "c"), (None, ["w1 w2 w3 w4"], "c")]
    df = spark.createDataFrame(rows, "sample_id long, document array<string>, rep string")
    got = {(r.sample_a, r.sample_b) for r in neardup.event_pairs(df).collect()}
    want = brute_pairs(texts)
    first = {}
    for i, x in sorted(texts.items()):
        first.setdefault(x, i)
    copies = {i for i, x in texts.items() if first[x] != i}
    assert got <= want and all(a in copies and b in copies for a, b in want - got)
    groups = {r.sample_id: r for r in neardup.event_groups(df).collect()}
    assert set(groups) == set(texts) and all(groups[a].group_id == groups[b].group_id for a, b in want)
    assert neardup.event_pairs(df.where("false")).count() == 0


def test_exact_copies_stay_a_class(spark):
    rows = [(k, ["one and the same long text of some words"], "c") for k in range(300)] + [(999, ["one and the same long text of some words indeed"], "c")]
    df = spark.createDataFrame(rows, "sample_id long, document array<string>, rep string")
    got = {(r.sample_a, r.sample_b) for r in neardup.event_pairs(df).collect()}
    assert got == {(0, k) for k in range(1, 300)} | {(k, 999) for k in range(300)}
    assert {r.group_id for r in neardup.event_groups(df).collect()} == {0}


# 6: nearest vectors


def test_nearest_recall_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = blobs(rng, [300, 200, 120], 200).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 9, axis=0)])
    odd = [(9001, 0, None, None, 1, 2, 3), (9002, 0, "", [0.0] * 64, 1, 2, 3), (9003, 0, "", [float("inf")] * 64, 1, 2, 3), (5, 0, "text 5", [float(v) for v in x[5]], 1, 2, 3)]
    df = nodes(spark, x, extra=odd)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-np.round(s, 6), axis=1, kind="stable")[:, :5]
    want = {(min(a, int(b)), max(a, int(b))) for a in range(len(x)) for b in best[a] if s[a, b] >= 0.8}
    got = {(r.node_a, r.node_b) for r in nearest.near_pairs(df).collect()}
    assert len(want & got) / len(want) >= 0.9 and len(want & got) / len(got) >= 0.9
    rows = nearest.nearest(df).collect()
    assert set(Counter(r.node_id for r in rows).values()) == {5} and not any(r.node_id == r.neighbour for r in rows)
    copies = [r for r in rows if r.node_id == 820]
    assert {r.neighbour for r in copies} <= {0, *range(820, 829)} and all(r.similarity == pytest.approx(1, abs=1e-6) for r in copies)
    assert nearest.nearest(df.where("false")).count() == 0
    assert nearest.nearest(df.where("node_id = 1")).count() == 0
    assert nearest.nearest(df.where("node_id in (1, 2)")).count() == 2


def test_nearest_recall_in_a_dense_third_and_among_loners(spark):
    rng = np.random.default_rng(2)
    x = blobs(rng, [8000, *[100] * 120], 4000, spread=0.045).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    table = pa.table({"node_id": np.arange(len(x)), "layer": np.zeros(len(x), np.int32), "embeddings": list(x)})
    found = nearest.nearest(spark.createDataFrame(table)).toArrow()
    got = set(zip(found["node_id"].to_pylist(), found["neighbour"].to_pylist()))
    assert len(got) == found.num_rows == 5 * len(x)
    for part in (range(0, 8000, 20), range(8000, 20000, 30), range(20000, 24000, 10)):
        s = u[part] @ u.T
        s[np.arange(len(part)), part] = -2
        best = np.argpartition(-s, 4, axis=1)[:, :5]
        assert np.mean([(q, int(b)) in got for q, row in zip(part, best) for b in row]) >= 0.9


def test_nearest_recall_without_near_neighbours(spark):
    x = np.random.default_rng(4).normal(size=(12000, 64)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = nearest.nearest(spark.createDataFrame(pa.table({"node_id": np.arange(len(x)), "layer": np.zeros(len(x), np.int32), "embeddings": list(x)}))).toArrow()
    got = set(zip(found["node_id"].to_pylist(), found["neighbour"].to_pylist()))
    s = u[:400] @ u.T
    s[np.arange(400), np.arange(400)] = -2
    best = np.argpartition(-s, 4, axis=1)[:, :5]
    assert np.mean([(q, int(b)) in got for q, row in enumerate(best) for b in row]) >= 0.9


def test_probes_do_not_depend_on_the_batch():
    x = np.random.default_rng(6).normal(size=(900, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[:40]
    near = np.stack([centres[0], centres[1], centres[2:].mean(0)])
    index = nearest.Index(near, centres, np.minimum(np.arange(40), 2), x)  # two groups of one list
    batch = index.probes(np.concatenate([index.centres[:1] + index.centres[1:2], index.centres[2:]]), 8, 2)
    assert batch.shape[1] == 8 and set(batch[0]) == {0, 1, -1}
    assert (batch[1:] >= 0).all()


def indexed(x, lists, groups=1):
    near = nearest.spherical_means(x, groups)
    own = (x @ near.T).argmax(1)
    parts = [nearest.spherical_means(x[own == g], lists // groups, seed=2) for g in range(groups)]
    return nearest.Index(near, np.concatenate(parts), np.repeat(np.arange(groups), lists // groups), x)


def test_expected_nearer_members():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = indexed(x, 8)
    s = x @ index.centres.T
    own, n = s.argmax(1), np.bincount(s.argmax(1), minlength=s.shape[1])
    lean = np.bincount(own, s.max(1)) / n
    index.shape = np.stack([n, lean, np.sqrt((1 - np.bincount(own, s.max(1) ** 2) / n) / 63)]).astype(np.float32)
    index.group_shape = np.ones((3, 1), np.float32)
    probed = np.full((200, 8), -1)
    probed[:, 0] = 3
    e = index.nearer(x[:200], np.full(200, 0.3, np.float32), probed)
    true = ((x[:200] @ x.T >= 0.3) & (own != 3)).sum() - (own[:200] != 3).sum()  # less the vectors themselves
    assert e.shape == (200, 1) and 0.8 < e.sum() / true < 1.25


@pytest.mark.parametrize("size", [500, 5000])
def test_codes_decide_in_small_and_large_lists(size, monkeypatch):
    """Recall over lists of 500 and of 5 000 where only a share of the probed members is reranked; without the
    tables' order, the same number of members reranked finds little."""
    rng = np.random.default_rng(7)
    x = blobs(rng, [400] * 40, 4000, spread=0.045).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = indexed(x, len(x) // size)
    probed = index.probes(x, 6)
    codes, along = index.encode(x, probed[:, 0])
    ask = np.where((np.arange(len(x)) % 20 == 0)[:, None], probed, -1)
    looked, rerank = [0], nearest._rerank

    def counted(ids, x, qs, mine, ms, r, *rest):
        looked[0] += len(r)
        return rerank(ids, x, qs, mine, ms, r, *rest)

    monkeypatch.setattr(nearest, "_rerank", counted)
    at = np.arange(len(x))
    q, c, _ = nearest.search(at, x, probed[:, 0], ask, codes, along, index, 5)
    s = x[::20] @ x.T
    s[np.arange(len(s)), at[::20]] = -2
    best = np.argpartition(-s, 4, axis=1)[:, :5]
    want = {(20 * k, int(b)) for k, row in enumerate(best) for b in row if s[k, b] >= 0.8}
    sizes = np.bincount(probed[:, 0], minlength=len(index.centres))
    assert len(want & set(zip(q.tolist(), c.tolist()))) / len(want) >= 0.9
    assert looked[0] < 0.2 * sizes[ask[ask >= 0]].sum()


# 7: markup


@pytest.mark.parametrize(
    "text,want",
    [
        ("plain text", []), ("", []), ("So a < b, although c > 4. R&D took 5 * 7. The fee was $6 in 1782 and $9 later. See field_1_name, Item #39 [sic].", []),
        ("<p>x</p>", ["html"]), ("&lt;p&gt;x&lt;/p&gt;", ["html"]), ("a&nbsp;b", ["html"]), ("k<sup>2</sup>", ["html"]), ("<span style='x:8'>open", ["html"]),
        ("## Head\n\ntext", ["markdown"]), ("Head\n====\ntext", ["markdown"]), ("- a b\n- c d", ["markdown"]), ("|A|B|\n|---|---|\n|1|2|", ["markdown"]), ("```\nx\n```", ["markdown"]), ("see [this](p.md)", ["markdown"]),
        ("[[A|b]] text", ["wiki"]), ("* [[A]]\n* [[B]]", ["wiki"]), ("'''Bold''' x", ["wiki"]), ("{| class=\"t\"\n! A !! B\n|-\n| 1 || 2\n|}", ["wiki"]), ("== Head ==\nx", ["wiki"]),
        ("$$x^{2}$$", ["latex"]), ("\\sum_{i=1}^{4} t_{i}^{2} \\leq \\theta", ["latex"]), ("\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}", ["latex"]), ("\\sqrt{p^{2}+x^{2}}", ["latex"]),
        ("<p>x $\\theta$</p>", ["html", "latex"]), ("<p>x</p>\n\n## Head\n\ny", ["html", "markdown"]), ("Place - Year\nA - 1812", []), ("Σ n² ≤ 10", []),
    ],
)
def test_markup_kinds(text, want):
    assert markup.clean(text)[1] == want


def test_markup_keeps_structure():
    page = "<h2>Head</h2><script>var q=1;</script><ul><li>a<li>b</ul><pre>x = 1\ny = 2</pre><table><tr><th>P<th>Y<tr><td>O<td>1</table><p>k<sup>2</sup> &amp; more</p>"
    assert markup.clean(page)[0].split("\n") == ["## Head", "- a", "- b", "```", "x = 1", "y = 2", "```", "P | Y", "O | 1", "k^2 & more"]
    assert markup.clean("\\begin{tabular}{ll}\nA & B \\\\\n1 & 2 \\\\ \\hline\n\\end{tabular}")[0] == "A | B\n1 | 2"
    assert markup.clean("{| class=\"t\"\n! A !! B\n|-\n| 1 || 2\n|}")[0] == "A | B\n1 | 2"
    assert markup.clean("see [this](p.md) and **that**")[0] == "see this and that"
    menu = "".join(f"<div><a href=x>Link {k}</a></div>" for k in range(12)) + "".join(f"<p>{'A long sentence of real content here. ' * 6}</p>" for _ in range(8))
    cleaned = markup.clean(menu)[0]
    assert "Link 3" not in cleaned and cleaned.count("real content") == 48


def test_markup_events():
    p = markup._Lines.of("<p>a &lt; b &unknown; <x-y>c</x-y> &#233;<!-- n --></p>")
    assert [e for e in p.events if e[0] != "reference"] == [("tag", "p"), ("comment", ""), ("tag", "/p")]
    assert [n for k, n in p.events if k == "reference"] == ["lt", "#233"]
    assert "".join(p.rest).split() == ["a", "<", "b", "&unknown;", "<x-y>c</x-y>", "é"]
    assert markup.marks("* a\n* b\n[[C]]", False) == [("wiki", "mark"), ("shared", "bullet"), ("shared", "bullet")]


def test_planted_structure_survives():
    """Headings, lists, tables, code and formulas written in each notation come out in the plain one."""
    rng = random.Random(5)
    words = lambda: " ".join(rng.choices(["stone", "river", "mill", "tower", "field"], k=4))
    for _ in range(60):
        head, a, b, c, d = (words() for _ in range(5))
        notations = {
            "html": f"<h2>{head}</h2><ul><li>{a}</li><li>{b}</li></ul><table><tr><td>{c}</td><td>{d}</td></tr></table>",
            "markdown": f"## {head}\n\n* {a}\n* {b}\n\n| {c} | {d} |\n|---|---|\n",
            "wiki": f"== {head} ==\n* {a}\n* {b}\n{{|\n| {c} || {d}\n|}}\n[[x]]",
            "latex": f"\\subsection{{{head}}}\n\\begin{{itemize}}\n\\item {a}\n\\item {b}\n\\end{{itemize}}\n\\begin{{tabular}}{{ll}}\n{c} & {d} \\\\\n\\end{{tabular}}",
        }
        for kind, text in notations.items():
            lines = [x.strip() for x in markup.clean(text)[0].split("\n") if x.strip() and x.strip() != "x"]
            assert [re.sub("^#+", "#", lines[0]), *lines[1:]] == [f"# {head}", f"- {a}", f"- {b}", f"{c} | {d}"], kind


def test_markup_rows(spark):
    rows = [(1, "<b>x</b>", None, "t", "c"), (1, "<b>x</b>", None, "t", "c"), (2, None, None, None, "c"), (None, "<b>", None, None, "c"), (3, "<div>" * 3000 + "x", "", None, "c")]
    out = {(r.item_id, r.field_name): (r.text, r.markup) for r in markup.cleaned(spark.createDataFrame(rows, "item_id long, html string, latex string, table_body string, markup string")).collect()}
    assert out == {(1, "html"): ("x", ["html"]), (1, "table_body"): ("t", []), (3, "html"): ("x", ["html"]), (3, "latex"): ("", [])}


# 8: leaks


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    v = [f"t{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(v, k=rng.choice([5, 13, 30]))), " ".join(rng.choices(v, k=40))) for k in range(8)] + [(8, None, ""), (0, None, None)]
    docs = []
    for k in range(30):
        body = rng.choices(v, k=60)
        if k % 2:
            src = rng.choice(items[:8])[2].split()
            n = rng.choice([11, 12, 20])
            at = rng.randrange(len(src) - n)
            body[10:10] = src[at : at + n]
        docs.append((k, "İ ".join(body[:3]) + "; " + "-".join(body[3:]).upper(), "c"))
    docs += [(100, None, "c"), (101, "", "c"), docs[1]]
    d = spark.createDataFrame(docs, "doc_id long, text string, start string")
    i = spark.createDataFrame(items, "item_id long, question string, passage string")
    toks = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(t[k : k + 12]) for k in range(len(t) - 11)}
    want = {(a, x) for a, t, _ in docs for x, q, p in items if grams(toks(t)) & (grams(toks(q)) | grams(toks(p)))}
    rows = leak.leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and want
    text = {a: t for a, t, _ in docs}
    by = {x: toks(q) + ["|"] + toks(p) for x, q, p in items[:8]}
    for r in rows:
        part = toks(text[r.doc_id][r.start : r.end])
        assert len(part) == r.n_tokens >= 12 and any(by[r.item_id][k : k + 12] == part[:12] for k in range(len(by[r.item_id])))
    split = leak.MAX_PATTERNS
    leak.MAX_PATTERNS = 60
    try:
        assert sorted(map(tuple, leak.leaks(d, i).collect())) == sorted(map(tuple, rows))
    finally:
        leak.MAX_PATTERNS = split
    assert leak.leaks(d.where("false"), i).count() == 0 and leak.leaks(d, i.where("false")).count() == 0


def test_leaked_answers_and_reuse(spark, monkeypatch):
    q = " ".join(f"w{k}" for k in range(14))
    i = spark.createDataFrame([(1, q, None, "Red Barn"), (2, None, None, "w1")], "item_id long, question string, passage string, answer string")
    d = spark.createDataFrame([(1, f"x {q} y"), (2, f"{q}; the red barn"), (3, "the red barn w1")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.has_answer) for r in leak.leaks(d, i).collect()} == {(1, 1, False), (2, 1, True)}
    built = []
    monkeypatch.setattr(leak.Scanner, "__init__", lambda self, texts, run: built.append(run))
    leak._held.clear()
    assert leak._scanner("a", [], 12) is leak._scanner("a", [], 12) and len(built) == 1
    monkeypatch.setattr(leak, "MAX_TEXT", 5)
    with pytest.raises(ValueError):
        leak.leaks(d, i)


# 9: mixing


def test_permutation():
    for n in (1, 2, 3, 10, 257, 1000):
        assert sorted(mix.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_large_draws_are_draws():
    rng = np.random.default_rng(7)
    counts = np.array([3_000_000_000, 5, 1_500_000_001, 0, 40_000_000])
    want = int(counts.sum()) // 3
    got = np.array([mix.drawn(rng, counts, want) for _ in range(400)])
    assert (got.sum(1) == want).all() and (got >= 0).all() and (got <= counts).all()
    p = counts / counts.sum()
    spread = np.sqrt(want * p * (1 - p) * 2 / 3)
    assert (abs(got.mean(0) - want * p) <= 0.3 * spread + 0.5).all() and 0.8 < got[:, 0].std() / spread[0] < 1.2


def test_mix(spark):
    rng = random.Random(1)
    docs = [(k, "w " * rng.randrange(0, 90), rng.choice(["A", " a ", "b", "B", None, "c"]), "x") for k in range(400)] + [(1000, None, "a", "x"), (1001, "", "b", "x"), (1002, "v " * 3000, "c", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, size string")
    t = spark.createDataFrame([("A", 0.6, 1), ("b", 0.2, 3), ("C", 0.1, 9), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    sized = mix.sizes(d)
    plan = mix.plan(sized, t)
    words = Counter()
    for _, text, source, _ in docs:
        if source:
            words[source.strip().lower()] += len((text or "").split())
    total = sum(words.values())
    want = {s for s, share, most in (("A", 0.6, 1), ("b", 0.2, 3), ("C", 0.1, 9), ("none", 0.1, 4)) if words[s.lower()] * most < share * total}
    assert {r.source for r in plan.where("short").collect()} == want == {"A", "none"}
    got = mix.mixed(sized, plan, block=16, shard_slots=64).collect()
    uses = Counter((r.source, r.doc_id, u) for r in got for u in range(r.from_unit, r.to_unit))
    assert max(n for (s, _, _), n in uses.items() if s == "a") == 1 and max(uses.values()) <= 9
    assert all(0 <= r.from_unit < r.to_unit for r in got)
    shares = {r.source: r for r in mix.shares(mix.mixed(sized, plan, 16, 64), plan).collect()}
    assert shares["b"].units == pytest.approx(0.2 * total, rel=0.05) and shares["none"].units == 0
    again = mix.mixed(sized, plan, block=16, shard_slots=64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    empty = mix.plan(sized.where("false"), t)
    assert empty.count() == 4 and mix.mixed(sized.where("false"), empty).count() == 0
    tokens = mix.sizes(d, "tokens").where("doc_id = 1002").first()
    assert tokens["size"] >= 3000


# 10: reading level


def test_levels_on_held_out_documents(spark):
    rng = random.Random(3)
    words = {g: [f"{'abcde'[g - 1]}word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)] for g in range(1, 6)}
    common = [f"plain{chr(97 + k)}" for k in range(20)]
    truth = {k: rng.randrange(1, 6) for k in range(600)}
    docs = [(k, " ".join(rng.choice(words[g] if rng.random() < 0.6 else words[max(1, min(5, g + rng.choice([-1, 1])))] if rng.random() < 0.5 else common) for _ in range(60)), "c") for k, g in truth.items()]
    docs += [(900, None, "c"), (901, "too short", "c"), (902, "", "c"), docs[0]]
    labels = [(k, f"r{k % 3}", truth[k] if rng.random() < 0.85 else max(1, min(5, truth[k] + rng.choice([-1, 1]))), "c") for k in range(300)]
    labels += [labels[0], (1, "r9", None, "c"), (None, "r1", 3, "c"), (2, "r1", 9, "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, grade int, rating string")
    rows = level.reading_levels(d, lab).collect()
    got = {r.doc_id: r.grade for r in rows}
    assert set(got) == set(truth) and len(rows) == 601 and set(got.values()) <= {1, 2, 3, 4, 5}
    held = [k for k in truth if k >= 300]
    assert sum(got[k] == truth[k] for k in held) / len(held) >= 0.8
    assert {r.grade for r in level.reading_levels(d, lab.where("false")).collect()} == {3}
    assert level.reading_levels(d.where("false"), lab).count() == 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "siltgrove").rglob("*.py"):
        if "llm" not in p.relative_to(root / "siltgrove").parts:
            assert not re.search(r"(from|import)\s+\S*\bllm\b", p.read_text()), p
