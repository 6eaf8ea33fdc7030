"""The engine as one object: add documents, retrieve, answer, save, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import evaluate
from .plans import pipeline
from .session import exists, written
from .sources import store


class Engine:
    """Trees over documents, with the ways to ask them. Tables are DataFrames; nothing is held in the driver."""

    def __init__(self, spark: SparkSession, conf: Config | None = None) -> None:
        self.spark, self.conf = spark, conf or Config()
        self.docs: DataFrame | None = None
        self.nodes: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.sparse = None

    def add(self, docs: DataFrame) -> Engine:
        """Build the index over docs (doc_id, text) and those added before; a later row of a doc_id is left out."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
        if self.docs is not None:
            docs = self.docs.unionByName(docs.join(self.docs.select("doc_id"), "doc_id", "left_anti"))
        self.docs = written(docs.dropDuplicates(["doc_id"]), "documents")
        nodes, edges = pipeline.build(self.docs, self.conf)
        self.nodes, self.edges = written(nodes, "nodes"), written(edges, "edges")
        self.sparse = pipeline.sparse_index(self.nodes, self.conf)
        return self

    def _index(self) -> tuple[DataFrame, DataFrame]:
        if self.nodes is None or self.edges is None:
            raise ValueError("no index: add documents or load one")
        return self.nodes, self.edges

    def route(self, questions: DataFrame) -> DataFrame:
        """questions with the tree_id that answers them; see pipeline.routed()."""
        if "tree_id" in questions.columns or self.docs is None:
            return questions
        return pipeline.routed(questions, self.docs, self.conf)

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """query_id, rank, node_id and text of what each question (query_id, question) finds."""
        asked = self.route(questions).withColumnRenamed("question", "text")
        return pipeline.retrieve(*self._index(), asked, self.conf, self.sparse)

    def answer(self, questions: DataFrame) -> DataFrame:
        """query_id and answer of each question (query_id, question)."""
        index = (None, None) if self.conf.no_retrieval else self._index()
        return pipeline.answered(*index, self.route(questions), self.conf, self.sparse)[0]

    def ask(self, question: str, tree_id: int = 0) -> str:
        """The answer to one question."""
        row = self.spark.createDataFrame([(0, question, tree_id)], "query_id long, question string, tree_id int")
        return self.answer(row).first().answer

    def score(self, answers: DataFrame, gold: DataFrame) -> dict[str, float]:
        """The configured metrics of answers against gold (query_id, answer)."""
        return evaluate.evaluate(answers.select("query_id", F.col("answer").alias("prediction")), gold, metrics=self.conf.evaluation_metrics)

    def save(self, path: str) -> None:
        """Write the index below a folder, with its documents and its sparse part if it has one."""
        store.save_tree(*self._index(), path, self.conf.tree_save_chunk_size)
        if self.docs is not None:
            self.docs.write.mode("overwrite").parquet(f"{path}/documents")
        if self.sparse is not None:
            store.save_index(self.sparse, f"{path}/sparse")

    @classmethod
    def load(cls, spark: SparkSession, path: str, conf: Config | None = None) -> Engine:
        """An engine over an index that save() wrote."""
        out = cls(spark, conf)
        out.nodes, out.edges = store.load_tree(spark, path)
        if exists(spark, f"{path}/documents/_SUCCESS"):
            out.docs = spark.read.parquet(f"{path}/documents")
        if exists(spark, f"{path}/sparse/scopes/_SUCCESS"):
            out.sparse = store.load_index(spark, f"{path}/sparse")
        return out
