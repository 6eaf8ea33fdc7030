"""Splitting oversized texts at natural boundaries, all cuts at once by pointer doubling.

Every word end of a text is a boundary. For each boundary the farthest legal successor is found (the end of the
next piece, where that piece starts up to ``overlap`` words before the boundary); the table of successors is then
squared again and again, and the set of boundaries reached from the start doubles with it. So the greedy cuts of
all texts of an Arrow batch come out in log2(pieces) vector steps, without a loop over pieces or a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS, MAX_CHARS, OVERLAP = 120, 900, 15
WORD = "[^ \\t\\n\\r]+"
_WORD = re.compile(r"[^ \t\n\r]+")
#: Ends of sentences and clauses; closing marks may follow.
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")
_CLAUSE = re.compile(r"[,;:–—][\"'»”’)\]]*$")
#: Text of batches is cut in slices of about so many words, which bounds a worker's memory.
_SLICE = 400_000


def oversized(text: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """Whether a text exceeds a limit. Null is not oversized."""
    return F.coalesce((F.length(text) > max_chars) | (F.regexp_count(text, F.lit(WORD)) > max_words), F.lit(False))


def _words(text: str, max_chars: int) -> tuple[list[int], list[int], list[int]]:
    """Start, end and rank of each word: 3 a paragraph ends after it, 2 a sentence, 1 a clause, 0 none. A word over
    max_chars is taken as fragments within it, ranked -1: a cut there is the last resort."""
    start: list[int] = []
    end: list[int] = []
    rank: list[int] = []
    spans = [m.span() for m in _WORD.finditer(text)]
    for k, (a, b) in enumerate(spans):
        while b - a > max_chars:
            start.append(a)
            end.append(a + max_chars)
            rank.append(-1)
            a += max_chars
        start.append(a)
        end.append(b)
        gap = text[b : spans[k + 1][0]] if k + 1 < len(spans) else "\n\n"
        tail = text[max(a, b - 6) : b]
        rank.append(3 if gap.count("\n") > 1 else 2 if _SENTENCE.search(tail) else 1 if _CLAUSE.search(tail) or "\n" in gap else 0)
    return start, end, rank


def _last(marked: np.ndarray) -> np.ndarray:
    """For each position the last marked one at or before it, or -1."""
    return np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))


def _next(marked: np.ndarray) -> np.ndarray:
    """For each position the first marked one at or after it, or the length."""
    n = len(marked)
    return np.minimum.accumulate(np.where(marked, np.arange(n), n)[::-1])[::-1]


def cuts(starts: np.ndarray, ends: np.ndarray, ranks: np.ndarray, first: np.ndarray, max_words: int, max_chars: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every piece, for many texts at once. The arrays hold the words of all texts one after
    another, with offsets made to rise over texts; first holds each text's first word, and the number of words last."""
    n = len(starts)
    of = np.searchsorted(first, np.arange(n), side="right") - 1
    low, high = first[of], first[of + 1] - 1
    at = np.arange(n)
    # The farthest word that a piece starting at a word may end with, under both limits; at least the word itself.
    far = np.minimum(np.minimum(at + max_words - 1, np.searchsorted(ends, starts + max_chars, side="right") - 1), high)
    far = np.maximum(far, at)
    last = [_last(ranks >= r) for r in (3, 2, 1, 0)]

    def ending(begin: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The last word of the piece from begin: the farthest end of a paragraph or sentence in the later half of the
        window, else of a clause there, else any sentence end after `after`, else the farthest word."""
        f = far[begin]
        middle = np.maximum(begin + (f - begin) // 2, after)
        out = np.where(f >= high[begin], f, -1)
        for level, least in ((0, middle), (1, middle), (2, middle), (1, after), (2, after), (3, after)):
            c = last[level][f]
            out = np.where((out < 0) & (c > least), c, out)
        return np.where(out < 0, f, out)

    # Where the piece after a cut starts: at the first sentence start within the overlap, else at its first word.
    back = np.minimum(np.maximum(at - overlap + 1, low), high)
    opens = np.zeros(n, bool)
    opens[1:] = ranks[:-1] >= 2
    opens[first[:-1][first[:-1] < n]] = False  # a text's own start, whatever text comes before it in the batch
    begin = _next(opens)[back] if n else at
    begin = np.where(begin > at, back, begin)
    begin = at + 1 if overlap <= 0 else begin
    begin = np.minimum(begin, high)
    successor = ending(begin, at)
    plain = successor <= at  # the overlap left no room for anything new: start right after the cut
    begin = np.where(plain, np.minimum(at + 1, high), begin)
    successor = np.where(plain, ending(begin, at), successor)
    successor = np.where(at >= high, at, successor)

    reached = np.zeros(n, bool)
    heads = first[:-1][first[:-1] < first[1:]]
    reached[ending(heads, heads - 1)] = True
    step = successor
    while True:
        more = reached.copy()
        more[step[reached]] = True
        step = step[step]
        if (more == reached).all() and (step[reached] == high[reached]).all():
            break
        reached = more
    to = np.flatnonzero(reached)
    froms = np.empty(len(to), np.int64)
    fresh = np.ones(len(to), bool)
    fresh[1:] = of[to[1:]] != of[to[:-1]]
    froms[fresh] = low[to[fresh]]
    later = np.flatnonzero(~fresh)
    froms[later] = begin[to[later - 1]]
    return froms, to


def split_texts(texts: list[str], max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[list[str]]:
    """The pieces of each text. A text without a word gives no piece."""
    starts: list[int] = []
    ends: list[int] = []
    ranks: list[int] = []
    first, base, shift = [0], [], 0
    for t in texts:
        a, b, r = _words(t, max_chars)
        starts += [x + shift for x in a]
        ends += [x + shift for x in b]
        ranks += r
        first.append(len(starts))
        base.append(shift)
        shift += len(t) + max_chars + 1
    if not starts:
        return [[] for _ in texts]
    s, e, bounds = np.array(starts), np.array(ends), np.array(first)
    a, b = cuts(s, e, np.array(ranks), bounds, max_words, max_chars, min(overlap, max_words - 1))
    of = np.searchsorted(bounds, b, side="right") - 1
    out: list[list[str]] = [[] for _ in texts]
    for k, x, y in zip(of.tolist(), s[a].tolist(), e[b].tolist()):
        out[k].append(texts[k][x - base[k] : y - base[k]])
    return out


def split_long(items: DataFrame, text: str = "text", max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of each item: all columns of the input, with the text column holding the piece, and
    ``chunk_index`` (from 0 in reading order) and ``n_pieces``; columns of these two names are replaced.

    Texts within both limits pass through on the JVM side as their only piece, untouched. Longer ones come out as
    pieces of at most max_words words and max_chars code points, cut at the end of a paragraph, sentence, clause or
    word (within a word only where it is longer than max_chars alone); a piece starts up to overlap words before the
    end of the last. Null texts, and texts of white space only, give a null piece and one row. Repeated rows are
    split each on their own. An empty table gives an empty table.
    """
    items = items.drop("chunk_index", "n_pieces")
    long = oversized(F.col(text), max_words, max_chars)
    whole = F.when(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\r]")) > 0, F.col(text))
    short = items.where(~long).withColumns({text: whole, "chunk_index": F.lit(0), "n_pieces": F.lit(1)})
    schema = short.schema
    names = [f.name for f in schema if f.name not in ("chunk_index", "n_pieces")]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            texts, at = batch.column(text).to_pylist(), 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size < _SLICE):
                    size += len(texts[to]) // 5
                    to += 1
                got = split_texts(texts[at:to], max_words, max_chars, overlap)
                taken = pa.array([at + k for k, p in enumerate(got) for _ in p or [None]], pa.int32())
                pieces = [x for p in got for x in p or [None]]
                columns = [pa.array(pieces, batch.schema.field(text).type) if c == text else batch.column(c).take(taken) for c in names]
                columns += [pa.array([i for p in got for i in range(max(1, len(p)))], pa.int32()), pa.array([max(1, len(p)) for p in got for _ in p or [None]], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "chunk_index", "n_pieces"])
                at = to

    pieces = items.select(*names).where(long).mapInArrow(run, schema)
    return short.unionByName(pieces)


def project_items(wcep: DataFrame, nodes: DataFrame) -> DataFrame:
    """The articles of all events and the texts of all leaf nodes, as items with item_kind, item_id, doc_pos, text.
    Repeated rows are kept here; null articles and texts are left out."""
    articles = wcep.select(F.lit("wcep").alias("item_kind"), F.col("sample_id").alias("item_id"), F.posexplode("document").alias("doc_pos", "text"))
    leaves = nodes.where("layer = 0").select(F.lit("node").alias("item_kind"), F.col("node_id").alias("item_id"), F.lit(-1).alias("doc_pos"), "text")
    return articles.unionByName(leaves).where("text is not null")
