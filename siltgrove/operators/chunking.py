"""Chunking of documents for retrieval: sentences packed up to a number of tokens, and token statistics."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+|[^\w\s]")


def word_tokens(text: str) -> int:
    """Number of words and marks of a text: the default measure, which needs no vocabulary."""
    return len(_WORD.findall(text))


def white_tokens(text: str) -> int:
    """Number of runs of other than white space."""
    return len(text.split())


def pack(text: str, most: int, count: Callable[[str], int] = word_tokens) -> list[str]:
    """Chunks of at most `most` tokens: sentences (cut at full stops, exclamation and question marks and line feeds)
    packed in order, joined by a blank before each sentence's own. A sentence over the limit is cut at commas, colons
    and semicolons, packed by itself and given out at once, before what is still being packed; a part over the limit
    comes out as it is."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for sentence in re.split(r"[.!?\n]", text):
        if not sentence.strip():
            continue
        n = count(" " + sentence)
        if n > most:
            part: list[str] = []
            m = 0
            for piece in (p.strip() for p in re.split(r"[,;:]", sentence)):
                if not piece:
                    continue
                k = count(" " + piece)
                if part and m + k > most:
                    out.append(" ".join(part))
                    part, m = [], 0
                part.append(piece)
                m += k
            if part:
                out.append(" ".join(part))
            continue
        if held and size + n > most:
            out.append(" ".join(held))
            held, size = [], 0
        held.append(sentence)
        size += n
    if held:
        out.append(" ".join(held))
    return out


def chunks(docs: DataFrame, most: int = 100, count: Callable[[str], int] = word_tokens, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_index (from 0) and text of every chunk of every document; null and blank texts give none."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pack(t, most, count))

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), cut(F.col(text)).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("chunk_index", "text"))


def chunks_of_pages(docs: DataFrame, pages: str = "document", key: str = "sample_id", most: int = 100) -> DataFrame:
    """Chunks of documents that come as a list of passages: rejoined by line feeds, then cut."""
    return chunks(docs.select(F.col(key).alias("doc_id"), F.array_join(pages, "\n").alias("text")), most)


def sentences(text: Column) -> Column:
    """The non-blank parts of a text between delimiters."""
    return F.filter(F.split(text, "[.!?\\n]"), lambda s: F.trim(s) != "")


def token_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Total, mean, most and least number of words and marks per document, over its parts between delimiters."""
    n = F.aggregate(sentences(F.col(text)), F.lit(0), lambda s, x: s + F.size(F.regexp_extract_all(x, F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]"), F.lit(0))))
    return docs.where(F.col(text).isNotNull()).select(n.cast("long").alias("n")).agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"))
