"""Corpora from files: JSON arrays, JSON lines, JSON in text files, by adapters with fixed schemas; gold and queries."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import flatten_transcript, title_body, word_count

# Words of a long document, the standing question about events, the fields of each dataset's records.
LONG_DOCUMENT = 6000
SUMMARISE = "Summarize the contents of this news event."
SCHEMAS = {
    "corpus": "title string, text string, body string, idx string",
    "questions": "id string, question string, query string, answer string, gold_ans string, reference string, golden_answers array<string>, answer_aliases array<string>, obj string, possible_answers string, o_wiki_title string, o_aliases string, "
    "contexts array<struct<title:string,text:string,is_supporting:boolean>>, paragraphs array<struct<idx:int,title:string,text:string,paragraph_text:string,is_supporting:boolean>>, "
    "evidence_list array<struct<fact:string>>, supporting_facts array<array<string>>, context array<array<string>>, document struct<id:string>, question_decomposition array<string>",
    "books": "context string, input string, answer string",
    "meetings": "meeting_transcripts array<struct<speaker:string,content:string>>, general_query_list array<struct<query:string,answer:string>>",
    "events": "document array<string>, summary string",
}
# End of fixed values.


def read_json(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """Records of a JSON array (or of one JSON per line), with a fixed schema and `ordinal`, their position in it.
    Fields that a record lacks are null."""
    rows = spark.read.schema(SCHEMAS[kind]).option("multiLine", not lines).json(path)
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def read_text_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of a text file with one JSON per line; lines that aren't JSON give null fields."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.from_json("value", SCHEMAS[kind]).alias("x")).select("x.*").withColumn("ordinal", F.monotonically_increasing_id())


def sample(rows: DataFrame, n: int) -> DataFrame:
    """The first n records by ordinal, all for n <= 0: a test run's limit."""
    return rows if n <= 0 else rows.orderBy("ordinal").limit(n)


def passages(rows: DataFrame, body: str = "text") -> DataFrame:
    """doc_id and text of a corpus of titled passages."""
    return rows.select(F.col("ordinal").alias("doc_id"), title_body(F.col("title"), F.col(body)).alias("text"))


def grouped(rows: DataFrame) -> DataFrame:
    """doc_id (the part of idx before its first underscore) and its passages in order, documents as first seen."""
    keyed = rows.select(F.substring_index("idx", "_", 1).alias("doc_id"), "ordinal", title_body(F.col("title"), F.col("text")).alias("text"))
    return keyed.groupBy("doc_id").agg(F.min("ordinal").alias("ordinal"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]).alias("passages"))


def books(rows: DataFrame) -> DataFrame:
    """One document per 100-character prefix: the last text, at the first position."""
    from ..operators.ranking import by_prefix

    return by_prefix(rows, "context", "ordinal").select(F.col("ordinal").alias("doc_id"), F.col("context").alias("text"), "prefix")


def meetings(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("ordinal").alias("doc_id"), flatten_transcript(F.col("meeting_transcripts")).alias("text"))


def events(rows: DataFrame, long: int = LONG_DOCUMENT) -> DataFrame:
    """Joined articles of events of more than `long` words, with the standing question and the summary as gold."""
    text = F.array_join("document", " ")
    return rows.withColumn("text", text).where(word_count(text) > long).select(F.col("ordinal").alias("doc_id"), "text", F.lit(SUMMARISE).alias("question"), F.array("summary").alias("gold"))


def gold_documents(joiner: str = "") -> Column:
    """The distinct supporting texts of a question record, whichever fields it has; null if it has none."""
    gold_titles = F.transform("supporting_facts", lambda f: f[0])
    body = lambda c: F.array_join(F.from_json(c[1], "array<string>"), joiner)
    from_facts = F.transform(F.filter("context", lambda c: F.array_contains(gold_titles, c[0])), lambda c: title_body(c[0], body(c)))
    from_contexts = F.transform(F.filter("contexts", lambda c: c["is_supporting"]), lambda c: title_body(c["title"], c["text"]))
    from_paragraphs = F.transform(F.filter("paragraphs", lambda p: F.coalesce(p["is_supporting"], F.lit(True))), lambda p: title_body(p["title"], F.coalesce(p["text"], p["paragraph_text"])))
    from_evidence = F.transform("evidence_list", lambda e: e["fact"])
    return F.array_distinct(F.when(F.col("supporting_facts").isNotNull(), from_facts).when(F.col("contexts").isNotNull(), from_contexts).when(F.col("paragraphs").isNotNull(), from_paragraphs).otherwise(from_evidence))


def gold_answers() -> Column:
    """The distinct gold answers of a question record by precedence of its fields, with aliases; null if it has none."""
    one = lambda c: F.array(F.col(c))
    entity = F.filter(F.array("obj", "possible_answers", "o_wiki_title", "o_aliases"), lambda x: x.isNotNull())
    base = F.when(F.col("answer").isNotNull(), one("answer")).when(F.col("gold_ans").isNotNull(), one("gold_ans")).when(F.col("reference").isNotNull(), one("reference")).when(F.col("obj").isNotNull(), entity).otherwise(F.col("golden_answers"))
    return F.array_distinct(F.concat(base, F.coalesce("answer_aliases", F.array().cast("array<string>"))))


def load(spark: SparkSession, folder: str, name: str, test_samples: int = -1) -> dict[str, DataFrame]:
    """passages (doc_id, text), queries (query_id, question and, where each belongs to a document, doc_id) and gold
    (query_id, answers, documents) of a dataset: a pair `name.json` and `name_corpus.json`, `name.jsonl` (books with
    questions, or meetings, as its first record says), or `name.txt` (events). Corpora whose passages have an idx
    `document_part` are joined to documents, which questions name."""
    at = lambda s: os.path.join(folder, name + s)
    if os.path.exists(at("_corpus.json")):
        c, q = sample(read_json(spark, at("_corpus.json"), "corpus"), test_samples), sample(read_json(spark, at(".json"), "questions"), test_samples)
        c = c.withColumn("text", F.coalesce("text", "body"))
        if not c.where("idx like '%\\\\_%' and idx is not null").isEmpty() and not q.where("document.id is not null").isEmpty():
            docs = grouped(c)
            named = q.join(docs.select(F.col("doc_id").alias("key"), F.col("ordinal").alias("doc_id")), q.document.id == F.col("key"), "left")
            return {"passages": docs.select(F.col("ordinal").alias("doc_id"), F.array_join("passages", "\n").alias("text")), "queries": named.select(F.col("ordinal").alias("query_id"), F.coalesce("question", "query").alias("question"), "doc_id"), "gold": q.select(F.col("ordinal").alias("query_id"), gold_answers().alias("answers"), gold_documents(" ").alias("documents"))}
        return {"passages": passages(c), "queries": q.select(F.col("ordinal").alias("query_id"), F.coalesce("question", "query").alias("question")), "gold": q.select(F.col("ordinal").alias("query_id"), gold_answers().alias("answers"), gold_documents().alias("documents"))}
    if os.path.exists(at(".txt")):
        e = events(sample(read_text_json(spark, at(".txt"), "events"), test_samples))
        return {"passages": e.select("doc_id", "text"), "queries": e.select(F.col("doc_id").alias("query_id"), "question", "doc_id"), "gold": e.select(F.col("doc_id").alias("query_id"), F.col("gold").alias("answers"), F.lit(None).cast("array<string>").alias("documents"))}
    if os.path.exists(at(".jsonl")):
        first_line = spark.read.text(at(".jsonl")).where("trim(value) <> ''").first()
        if first_line and "context" in json.loads(first_line.value):
            b = sample(read_json(spark, at(".jsonl"), "books", True), test_samples)
            docs = books(b)
            asked = b.withColumn("prefix", F.substring("context", 1, 100)).join(docs.select("prefix", "doc_id"), "prefix", "left")
            return {"passages": docs.select("doc_id", "text"), "queries": asked.select(F.col("ordinal").alias("query_id"), F.col("input").alias("question"), "doc_id"), "gold": b.select(F.col("ordinal").alias("query_id"), F.array("answer").alias("answers"), F.lit(None).cast("array<string>").alias("documents"))}
        m = sample(read_json(spark, at(".jsonl"), "meetings", True), test_samples)
        first = F.col("general_query_list")[0]
        return {"passages": meetings(m), "queries": m.select(F.col("ordinal").alias("query_id"), first["query"].alias("question"), F.col("ordinal").alias("doc_id")), "gold": m.select(F.col("ordinal").alias("query_id"), F.array(first["answer"]).alias("answers"), F.lit(None).cast("array<string>").alias("documents"))}
    raise FileNotFoundError(at(".json"))
