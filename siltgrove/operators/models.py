"""Models as vectorised functions: what a backend must offer, deterministic local ones, retries, prompts."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Abstractor(Protocol):
    def abstract(self, text: str, words: int, leaf: bool) -> str: ...


class Reader(Protocol):
    def answer(self, messages: list[dict[str, str]]) -> str: ...


class Reranker(Protocol):
    def scores(self, query: str, documents: list[str]) -> list[float]: ...


def _number(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")


class HashingEmbedder:
    """Signed feature hashing of words, of unit length; the zero vector for a text without words."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for k, t in enumerate(texts):
            for w, n in Counter(_WORD.findall((t or "").lower())).items():
                h = _number(w)
                out[k, h % self.width] += n if h >> 63 else -n
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class LeadAbstractor:
    """The first words of a text."""

    def abstract(self, text: str, words: int = 100, leaf: bool = True) -> str:
        return " ".join(text.split()[:words])


class KeywordAbstractor:
    """The most frequent words of four letters and more; ties in order of appearance."""

    def abstract(self, text: str, words: int = 20, leaf: bool = True) -> str:
        found = [w for w in _WORD.findall(text.lower()) if len(w) > 3]
        first = {w: k for k, w in reversed(list(enumerate(found)))}
        return ", ".join(w for w, _ in sorted(Counter(found).items(), key=lambda x: (-x[1], first[x[0]]))[:words])


class PromptedAbstractor:
    """Abstracts by any text model: generate takes a prompt and gives text. keywords asks for a list instead of prose."""

    def __init__(self, generate: Callable[[str], str], keywords: bool = False) -> None:
        self.generate, self.keywords = generate, keywords

    def prompt(self, text: str, words: int, leaf: bool) -> str:
        """What is asked of the model: the form, what the material is, its limit, the material."""
        form = "comma-separated keywords, the most telling first" if self.keywords else "one plain paragraph"
        material = "excerpts of documents" if leaf else ("keyword lists of related groups; merge what they share" if self.keywords else "abstracts of related groups; say what joins them")
        return f"FORM: {form}\nLIMIT: {words} words\nMATERIAL: {material}\n---\n{text}"

    def abstract(self, text: str, words: int = 100, leaf: bool = True) -> str:
        return " ".join(self.generate(self.prompt(text, words, leaf)).split()[:words])


class OverlapReranker:
    """The share of a query's words that a document has."""

    def scores(self, query: str, documents: list[str]) -> list[float]:
        q = set(_WORD.findall(query.lower()))
        return [len(q & set(_WORD.findall(d.lower()))) / max(1, len(q)) for d in documents]


class ExtractiveReader:
    """Answers with the sentence of the last message that shares most words with its question."""

    def answer(self, messages: list[dict[str, str]]) -> str:
        question, passages = read_turn(messages[-1]["content"])
        asked = set(_WORD.findall(question.lower()))
        best = max(re.split(r"(?<=[.!?])\s+|\n+", passages), key=lambda s: len(asked & set(_WORD.findall(s.lower()))), default="")
        return f"Thought: the documents say so.\nAnswer: {best.strip() or 'Not mentioned'}"


class ScriptedReader(ExtractiveReader):
    """An extractive reader that looks up once more, by the words of its best sentence, before it answers: it opens a
    second round whenever the turn lets it."""

    def answer(self, messages: list[dict[str, str]]) -> str:
        said = super().answer(messages)
        text = messages[-1]["content"]
        asked = read_turn(text)[0]
        if sum(m["role"] == "user" and read_turn(m["content"])[0] == asked for m in messages) > 1 or turn_is_last(text):
            return said
        return f"Thought: one more look.\nRetrieve: {said.rpartition('Answer: ')[2]}"


#: Backends by the names that settings use; others are registered by adding to these.
EMBEDDERS: dict[str, Callable[[int], Embedder]] = {"hashing": HashingEmbedder}
ABSTRACTORS: dict[str, Callable[[], Abstractor]] = {"summary": LeadAbstractor, "keyword": KeywordAbstractor}
READERS: dict[str, Callable[[], Reader]] = {"extractive": ExtractiveReader, "scripted": ScriptedReader}
RERANKERS: dict[str, Callable[[], Reranker]] = {"overlap": OverlapReranker}


def backend(known: dict, name: str):  # noqa: ANN001, ANN201
    """The backend of that name; an unknown name raises with those there are."""
    if name not in known:
        raise ValueError(f"unknown backend {name}: one of {sorted(known)}")
    return known[name]


def with_retries(call: Callable[[], object], attempts: int = 6, least: float = 1.0, most: float = 20.0, sleep: Callable[[float], None] = time.sleep):  # noqa: ANN201
    """(result, error): the call's result, after waits that double, or None and the last error's text."""
    error = ""
    for k in range(attempts):
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if k + 1 < attempts:
                sleep(min(most, least * 2**k) * (0.5 + random.random() / 2))
    return None, error


def embedding_of(text: Column, make: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """Embeddings of a text column; the model is made once per Python worker's batch iterator. Null gives null."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            rows = model.embed([t or "" for t in s])
            yield pd.Series([None if t is None else r.tolist() for t, r in zip(s, rows)])

    return embed(text)


def abstract_of(text: Column, words: int, leaf: bool, make: Callable[[], Abstractor] = LeadAbstractor) -> Column:
    """A struct of text, the abstract, and error, why there is none after all attempts. Null gives both null."""

    @F.pandas_udf("struct<text:string,error:string>")
    def abstract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for s in batches:
            yield pd.DataFrame([(None, None) if t is None else with_retries(lambda t=t: model.abstract(t, words, leaf)) for t in s], columns=["text", "error"])

    return abstract(text)


# Prompts. A turn is a few labelled lines that read_turn() reads back, so readers of any kind get its parts.
LENGTHS = {"short": "a few words", "medium": "one sentence", "long": "one paragraph", "auto": "as many words as it needs"}
_ASKS, _LOOKUPS, _FOUND = "ASKED", "LOOKUPS", "FOUND"
_OPEN = "{n} more allowed"
_LAST = "none left, so this reply must be an `Answer: `"
ABSTENTION = "Not mentioned"


def turn(passages: str, question: str, remaining: int) -> str:
    """What a reader is told in one round: the question, whether it may look up again, and the passages found. At
    exactly 0 remaining lookups it must answer."""
    allowed = _LAST if remaining == 0 else _OPEN.format(n=remaining)
    return "\n".join((f"{_ASKS}: {question}", f"{_LOOKUPS}: {allowed}", f"{_FOUND}:", passages))


def read_turn(text: str) -> tuple[str, str]:
    """Question and passages of a turn, or of any text in their place: no question, all passages."""
    m = re.match(rf"{_ASKS}: (.*?)\n(?:{_LOOKUPS}: [^\n]*\n)?{_FOUND}:\n?(.*)", text, re.S)
    return (m[1], m[2]) if m else ("", text)


def turn_is_last(text: str) -> bool:
    return f"{_LOOKUPS}: {_LAST}\n" in text


def rules(times: int, kind: str, words: int) -> str:
    """The reply format that parse_response() reads, as a list."""
    return "\n".join((
        f"Each message gives you a question ({_ASKS}), how often you may still search ({_LOOKUPS}) and passages ({_FOUND}). Build every reply from two parts:",
        f"1. `Thought: ` with your reasoning, {words} words at most;",
        f"2. on a line of its own either `Retrieve: ` with one search ({times} in all) or `Answer: ` with {LENGTHS[kind]}.",
        f"Where the passages are silent, the answer is `{ABSTENTION}`.",
    ))


def example(times: int) -> list[dict[str, str]]:
    """A worked exchange that shows both replies: a search, where one is allowed, and an answer."""
    question = "Who painted the ceiling of the town hall that burnt down in 1911?"
    first, second = "Two town halls burnt down: that of Brenn in 1874 and that of Saltau in 1911.", "The ceiling in Saltau was the work of Ida Klee."
    search = [{"role": "user", "content": turn(first, question, times)}, {"role": "assistant", "content": "Thought: 1911 points to Saltau; the painter is still unknown.\nRetrieve: painter of the ceiling in the town hall of Saltau"}]
    close = [{"role": "user", "content": turn(second if times > 0 else f"{first} {second}", question, max(0, times - 1))}, {"role": "assistant", "content": "Thought: Saltau's ceiling was painted by Ida Klee.\nAnswer: Ida Klee"}]
    return [*(search if times > 0 else []), *close]


def agent_messages(documents: str, question: str, times: int, kind: str = "short", words: int = 500, shots: bool = True) -> list[dict[str, str]]:
    """The first messages of an agent: rules, a worked exchange, the first turn."""
    return [{"role": "system", "content": rules(times, kind, words)}, *(example(times) if shots else []), {"role": "user", "content": turn(documents, question, times)}]


def plain_prompt(documents: str, question: str, kind: str = "short", retrieval: bool = True) -> list[dict[str, str]]:
    """Messages of a single-shot answer, with or without passages."""
    source = f"Use the passages ({_FOUND}) only" if retrieval else "Use what you know"
    asked = f"{_ASKS}: {question}" + (f"\n{_FOUND}:\n{documents}" if retrieval else "")
    return [{"role": "system", "content": f"{source}. Close with `Answer: ` and {LENGTHS[kind]}."}, {"role": "user", "content": asked}]
