"""Languages as their words and letters show them, learned from rows that name their language.

Counts of words, and of runs of three letters in words, of labelled rows make a naive Bayes model. Words with a
capital are left out but for a text's first one: they are mostly names, which belong to no language. Labels may be
wrong here and there, or spelled in other case; a language with few rows isn't learned.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that fit the model, about, chosen by a hash of their text; rows a language needs, and its least share.
LABELLED, LEAST_ROWS, LEAST_SHARE = 6_000, 5, 0.003
#: Buckets of features, smoothing, words that mark a language alone, and how much likelier than elsewhere they are.
BUCKETS, ALPHA, MARKS, OWN = 1 << 16, 0.1, 120, 8.0
_WORD = re.compile(r"[^\W\d_]+")


def plain_words(text: str) -> list[str]:
    """The words of a text that may tell its language: its first, and all without a capital, lower-cased."""
    words = _WORD.findall(text)
    return [w.lower() for k, w in enumerate(words) if k == 0 or w.islower()]


def features(words: list[str]) -> list[int]:
    """Bucket numbers of words and of their runs of three letters, edges included."""
    out = []
    for w in words:
        edged = f"<{w}>"
        out.append(zlib.crc32(edged.encode("utf-8", "surrogatepass")) % BUCKETS)
        out += [zlib.crc32(edged[k : k + 3].encode("utf-8", "surrogatepass")) % BUCKETS for k in range(len(edged) - 2)]
    return out


@dataclass
class Languages:
    """Names, log probabilities of features (a row per language), and words of one language only."""

    names: list[str] = field(default_factory=list)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    own: list[frozenset] = field(default_factory=list)

    def scores(self, words: list[str]) -> np.ndarray:
        """Mean log probability per feature in each language, and their number in the last place."""
        f = features(words)
        return np.r_[self.logs[:, f].mean(1) if f else np.zeros(len(self.names)), len(f)]

    def of_words(self, distinct: set[str]) -> int:
        """The number of the language that most of the distinct words mark; the first where none does."""
        counts = [len(distinct & own) for own in self.own]
        return counts.index(max(counts)) if counts else 0


def fit(labelled: DataFrame) -> Languages:
    """The model of labelled (text, lang). About LABELLED rows are read whole; null texts and labels are left out. No
    labels give a model without languages. At most BUCKETS rows and MARKS words a language come to the driver."""
    rows = labelled.select("text", F.lower(F.trim("lang")).alias("lang")).where("text is not null and lang is not null and lang <> ''")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(64).collect()}
    total = sum(sizes.values())
    names = sorted(k for k, n in sizes.items() if n >= LEAST_ROWS and n >= LEAST_SHARE * total)
    if len(names) < 2:
        return Languages()
    if total > LABELLED:
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) < int(LABELLED / total * (1 << 30)))
    number = {k: i for i, k in enumerate(names)}

    def count(batches):  # noqa: ANN001, ANN202
        seen = np.zeros((len(names), BUCKETS), np.int64)
        words: dict[tuple[int, str], int] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = number.get(lang)
                if k is None:
                    continue
                found = plain_words(text)
                np.add.at(seen[k], features(found), 1)
                for w in found:
                    words[k, w] = words.get((k, w), 0) + 1
        at = np.argwhere(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.nulls(len(at), pa.string()), pa.array(seen[at[:, 0], at[:, 1]])], names=["k", "f", "w", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in words], pa.int32()), pa.nulls(len(words), pa.int32()), pa.array([w for _, w in words], pa.string()), pa.array(list(words.values()), pa.int64())], names=["k", "f", "w", "n"])

    counted = rows.mapInArrow(count, "k int, f int, w string, n long").groupBy("k", "f", "w").agg(F.sum("n").alias("n"))
    counted = counted.where("f is not null or n >= 3").toArrow()
    k, f, w, n = (counted.column(c) for c in range(4))
    k, n, of = k.to_numpy(), n.to_numpy(), f.is_valid().to_numpy()
    seen = np.zeros((len(names), BUCKETS))
    seen[k[of], f.to_numpy(zero_copy_only=False)[of].astype(np.int64)] = n[of]
    logs = np.log((seen + ALPHA) / (seen.sum(1, keepdims=True) + ALPHA * BUCKETS)).astype(np.float32)
    totals = np.bincount(k[~of], weights=n[~of], minlength=len(names)) + 1.0
    share: dict[str, np.ndarray] = {}
    for a, x, c in zip(k[~of].tolist(), w.filter(pa.array(~of)).to_pylist(), n[~of].tolist()):
        share.setdefault(x, np.zeros(len(names)))[a] = c / totals[a]
    own = []
    for a in range(len(names)):
        mine = [(v[a], x) for x, v in share.items() if v[a] > OWN * np.delete(v, a).max()]
        own.append(frozenset(x for _, x in sorted(mine, reverse=True)[:MARKS]))
    return Languages(names, logs, own)
