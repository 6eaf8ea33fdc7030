"""Agents over a batch of open questions: retrieve, ask, parse, ask on; every round is a few joins for all questions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_answer, parse_response
from ..session import written
from .models import ExtractiveReader, Reader, agent_messages, plain_prompt
from .models import turn as turn_text

Retrieve = Callable[[DataFrame], DataFrame]


def _asking(make: Callable[[], Reader], kind: str, words: int, turn: int):  # noqa: ANN202
    """What asks a reader in one round: of question, documents, messages so far and lookups, the messages and the
    reply."""

    @F.pandas_udf("struct<messages:string,reply:string>")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make()
        for question, documents, messages, lookups in batches:
            out = []
            for q, d, m, n in zip(question, documents, messages, lookups):
                said = [*json.loads(m), {"role": "user", "content": turn_text(d, q, int(n) - turn)}] if m else agent_messages(d, q, int(n), kind, words)
                reply = model.answer(said)
                out.append((json.dumps([*said, {"role": "assistant", "content": reply}]), reply))
            yield pd.DataFrame(out, columns=["messages", "reply"])

    return ask


def run(questions: DataFrame, retrieve: Retrieve, most: int = 3, make: Callable[[], Reader] = ExtractiveReader, kind: str = "short", words: int = 500) -> tuple[DataFrame, DataFrame]:
    """(answers, rounds) of questions (query_id, question, and what retrieve needs). A column `lookups` gives each
    question a budget of its own, at most `most`; null counts as `most`.

    retrieve takes query_id and text and gives query_id and documents (one text). In each round the open questions'
    documents are looked up by their sub-question (the question itself at first) while the prompt keeps the question;
    a reply with `Retrieve: ` opens another round, any other answers. After `most` lookups beyond the first, what is
    still open gets the answer Error. rounds has query_id, round_no, subquestion, thought, action and payload.
    """
    own = F.least(F.coalesce(F.col("lookups"), F.lit(most)), F.lit(most)) if "lookups" in questions.columns else F.lit(most)
    questions = questions.withColumn("lookups", own.cast("int"))
    keep = [c for c in questions.columns if c not in ("query_id", "question")]
    state = questions.select("query_id", "question", *keep, F.col("question").alias("text"), F.lit("").alias("messages"))
    done = rounds = None
    for turn in range(most + 1):
        ask = _asking(make, kind, words, turn)
        docs = retrieve(state.select("query_id", "text", *keep))
        ready = state.join(docs, "query_id", "left").select("query_id", "question", *keep, "text", "messages", F.coalesce("documents", F.lit("")).alias("documents"))
        asked = written(ready.withColumn("r", ask("question", "documents", "messages", "lookups")).withColumn("p", parse_response(F.col("r.reply"))), "round")
        log = asked.select("query_id", F.lit(turn).alias("round_no"), F.col("text").alias("subquestion"), "p.thought", "p.action", "p.payload", "documents")
        rounds = log if rounds is None else rounds.unionByName(log)
        ended = asked.where("p.action = 'answer'").select("query_id", F.col("p.payload").alias("answer"))
        done = ended if done is None else done.unionByName(ended)
        state = asked.where("p.action = 'retrieve'").select("query_id", "question", *keep, F.col("p.payload").alias("text"), "r.messages")
        done = done.unionByName(state.where(F.col("lookups") <= turn).select("query_id", F.lit("Error").alias("answer")))
        state = state.where(F.col("lookups") > turn)
        if state.isEmpty():
            break
    return done, rounds


def single_shot(questions: DataFrame, documents: DataFrame | None, make: Callable[[], Reader] = ExtractiveReader, kind: str = "short") -> DataFrame:
    """query_id and answer in one pass: from documents (query_id, documents), or without any."""
    joined = questions.select("query_id", "question")
    joined = joined.join(documents, "query_id", "left") if documents is not None else joined.withColumn("documents", F.lit(None).cast("string"))
    given = documents is not None

    @F.pandas_udf("string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, d in batches:
            yield pd.Series([model.answer(plain_prompt(x or "", a, kind, given)) for a, x in zip(q, d)])

    return joined.select("query_id", parse_answer(ask("question", "documents")).alias("answer"))


def final_documents(rounds: DataFrame) -> DataFrame:
    """query_id and the distinct texts that all rounds found, in order: documents join texts by empty lines."""
    found = F.transform(F.array_sort(F.collect_list(F.struct("round_no", "documents"))), lambda x: F.split(x["documents"], "\n\n"))
    return rounds.groupBy("query_id").agg(F.array_distinct(F.flatten(found)).alias("documents"))
