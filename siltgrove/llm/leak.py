"""Evaluation texts leaking into a corpus: one Aho-Corasick automaton over the test items, one scan of the text.

The automaton's alphabet are the distinct tokens of the test items, its patterns all runs of ``run`` consecutive
tokens of a question or passage (a shared run of at least that length is a match of one of them), and all answers. It
is built once for each Python worker from the distinct patterns, whose number is bounded by the size of the test set,
not of the corpus; a test set over ``MAX_PATTERNS`` runs is cut into several automata, one scan of the corpus each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

RUN = 12
#: Runs in one automaton: about 100 MB of a worker's memory at most.
MAX_PATTERNS = 200_000
#: Characters of all test texts, at most: they come to the driver.
MAX_TEXT = 256_000_000
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    """Longest runs of letters and digits in the lower-cased text."""
    return _TOKEN.findall(text.lower())


class Scanner:
    """Token numbers, automaton and the items of each pattern, of some test texts: (item, text, whether an answer)."""

    def __init__(self, texts: list[tuple[int, str, bool]], run: int = RUN) -> None:
        self.run = run
        self.number: dict[str, int] = {}
        items: dict[tuple[int, ...], set[tuple[int, bool]]] = defaultdict(set)
        for item, text, answer in texts:
            ids = [self.number.setdefault(t, len(self.number) + 1) for t in tokens(text)]
            for k in range(0 if answer else len(ids) - run + 1):
                items[tuple(ids[k : k + run])].add((item, False))
            if answer and ids:
                items[tuple(ids)].add((item, True))
        self.any = any(not answer for of in items.values() for _, answer in of)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, of in items.items():
            self.automaton.add_word(pattern, tuple(sorted(of)))
        if items:
            self.automaton.make_automaton()


_held: dict[str, Scanner] = {}


def _scanner(name: str, texts: list[tuple[int, str, bool]], run: int) -> Scanner:
    """The scanner of that name, built once in this worker; the last one is kept."""
    if name not in _held:
        _held.clear()
        _held[name] = Scanner(texts, run)
    return _held[name]


def scan(text: str, scanner: Scanner) -> list[tuple[int, int, int, int, bool]]:
    """(item, start, end, tokens, answer) of each maximal stretch of the text covered by runs shared with an item, with
    offsets in the text as given; answer: the text also has the item's answer somewhere. Lower-casing that changes the
    length of a text is mapped back letter by letter."""
    number, automaton = scanner.number, scanner.automaton
    if not scanner.any:
        return []
    run, low = scanner.run, text.lower()
    ids: list[int] = []
    get, unknown_run, best = number.get, 0, 0
    spans = list(_TOKEN.finditer(low))
    for m in spans:
        n = get(m[0], 0)
        ids.append(n)
        unknown_run = unknown_run + 1 if n else 0
        best = max(best, unknown_run)
    if best < run:  # no stretch of known tokens is long enough for a match
        return []
    if len(low) != len(text):
        at = [k for k, c in enumerate(text) for _ in c.lower()]
        at.append(len(text))
    else:
        at = None
    last: dict[int, list[int]] = {}
    out: list[tuple[int, int, int, int]] = []
    answered: set[int] = set()

    def emit(item: int, a: int, b: int) -> None:
        s, e = spans[a].start(), spans[b].end()
        out.append((item, at[s] if at else s, at[e - 1] + 1 if at else e, b - a + 1))

    for end, items in automaton.iter(tuple(ids)):
        for item, answer in items:
            if answer:
                answered.add(item)
                continue
            held = last.get(item)
            if held and end - run + 1 <= held[1] + 1:
                held[1] = end
            else:
                if held:
                    emit(item, *held)
                last[item] = [end - run + 1, end]
    for item, (a, b) in last.items():
        emit(item, a, b)
    return [(*x, x[0] in answered) for x in out]


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Every stretch of a document that is shared with the question or the passage of a test item over at least run
    consecutive tokens: doc_id, item_id, start, end (code points in the text as given, end excluded), n_tokens, and
    has_answer: the document also holds the item's answer, as whole tokens, anywhere.

    docs has doc_id and text, items has item_id, question, passage and, if answers are to be looked for, answer; other
    columns are left aside, whatever their names. Null or empty texts match nothing, an item text under run tokens
    neither, an answer alone is no leak; an item several of whose texts match has each stretch, merged where they
    touch. Repeated documents give repeated rows. Empty tables give an empty table. The test items come to the driver:
    they are held-out material of a fixed size (over MAX_TEXT characters raise), whose number of runs bounds the
    automata (see MAX_PATTERNS); the corpus is scanned in place, without a shuffle, once for each automaton.
    """
    kinds = [("question", False), ("passage", False), *([("answer", True)] if "answer" in items.columns else [])]
    texts = items.select("item_id", F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(a).alias("a")) for c, a in kinds])).alias("x")).select("item_id", "x.t", "x.a").where("t is not null and item_id is not null").distinct()
    size = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > MAX_TEXT:
        raise ValueError(f"test items of {size} characters; {MAX_TEXT} at most")
    groups: list[list[tuple[int, str, bool]]] = [[]]
    held = 0
    by_item: dict[int, list[tuple[int, str, bool]]] = defaultdict(list)
    for r in texts.collect():
        by_item[r.item_id].append((r.item_id, r.t, r.a))
    for item in sorted(by_item):  # all texts of an item in one group, so that its stretches merge
        n = sum(1 if a else max(0, len(tokens(t)) - run + 1) for _, t, a in by_item[item])
        if held and held + n > MAX_PATTERNS:
            groups.append([])
            held = 0
        groups[-1] += by_item[item]
        held += n
    whole = spread(docs.where("text is not null").select(F.col("doc_id").cast("long"), "text"))
    name = uuid4().hex
    parts = [whole.mapInArrow(_find(docs, f"{name}-{k}", group, run), SCHEMA) for k, group in enumerate(groups)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SCHEMA = "doc_id long, item_id long, start long, end long, n_tokens int, has_answer boolean"


def _find(docs: DataFrame, name: str, group: list[tuple[int, str, bool]], run: int):  # noqa: ANN202
    """What scans batches of documents for a group's texts; each group is a broadcast of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(group)

    def find(batches):  # noqa: ANN001, ANN202
        scanner = _scanner(name, shared.value, run)
        for batch in batches:
            got = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in scan(text, scanner)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["doc_id", "item_id", "start", "end", "n_tokens", "has_answer"])

    return find
