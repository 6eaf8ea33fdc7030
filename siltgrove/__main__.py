"""Command line: python -m siltgrove index|answer|score|all|inspect|ask|chat [--config FILE] [--key value ...].

ask takes --question TEXT, --update (don't use the stored answer) and --tree_id N; inspect takes --layer N, --id N and
--tree_id N; chat reads questions until an empty line, quit or exit, and keeps the history.
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from . import config
from .functions.text import CURRENT, HISTORY
from .operators import agent, evaluate, inspect
from .plans import pipeline
from .session import clean, exists, session
from .sources import corpus, store

USAGE = __doc__


def _take(rest: list[str], name: str, flag: bool = False) -> str | bool | None:
    """An option of a single command, taken out of the arguments."""
    if name not in rest:
        return None
    k = rest.index(name)
    value = True if flag else rest[k + 1]
    del rest[k : k + 1 + (not flag)]
    return value


def history_text(turns: list[tuple[str, str]], question: str) -> str:
    """A question with the conversation before it; see functions.text.history for the Column."""
    if not turns:
        return question
    return HISTORY + "\n".join(f"{r.capitalize()}: {c}" for r, c in turns) + CURRENT + question


def ask(spark, conf, at: str, question: str, tree_id: int = 0, update: bool = False, store_path: str | None = None) -> str:  # noqa: ANN001
    """The answer to one question, from the store of answers (by tree and question) unless update is set."""
    path = Path(store_path or f"{conf.save_dir}/{conf.dataset}_query.json")
    held = json.loads(path.read_text()) if path.exists() else {}
    key = json.dumps([tree_id, question])
    if key not in held or update:
        nodes, edges = store.load_tree(spark, at)
        rows = spark.createDataFrame([(0, question)], "query_id long, question string")
        held[key] = pipeline.answer(nodes.where(F.col("tree_id") == tree_id), edges.where(F.col("tree_id") == tree_id), rows.withColumn("tree_id", F.lit(tree_id)), conf).first().answer
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(held))
    return held[key]


def log(conf, text: str) -> None:  # noqa: ANN001
    """A line in the run's log."""
    Path(conf.log_path).mkdir(parents=True, exist_ok=True)
    with Path(conf.log_path, f"{conf.dataset}.log").open("a") as f:
        f.write(f"{time.strftime('%Y-%m-%d %H:%M:%S')} {text}\n")


def main(args: list[str]) -> int:
    if not args or args[0] not in ("index", "answer", "score", "all", "inspect", "ask", "chat"):
        print(USAGE)
        return 2
    what, rest = args[0], list(args[1:])
    path = None
    if "--config" in rest:
        k = rest.index("--config")
        path = rest[k + 1]
        del rest[k : k + 2]
    question, update = _take(rest, "--question") or _take(rest, "-q"), bool(_take(rest, "--update", True))
    tree_id, layer, node = (int(v) if (v := _take(rest, x)) is not None else None for x in ("--tree_id", "--layer", "--id"))
    conf = config.load(path, rest)
    spark = session()
    try:
        return _run(spark, what, args, conf, question, update, tree_id, layer, node)
    finally:
        clean(spark)


def _run(spark, what: str, args: list[str], conf, question, update: bool, tree_id: int | None, layer: int | None, node: int | None) -> int:  # noqa: ANN001
    """One command, in a session whose written tables are removed after it."""
    log(conf, " ".join(args))
    at, results = f"{conf.save_dir}/{config.artefact(conf)}", f"{conf.save_dir}/{conf.dataset}_results"
    data = corpus.load(spark, conf.data_dir, conf.dataset, conf.test_samples) if what not in ("inspect", "ask", "chat") else {}
    times = {}
    if what in ("index", "all"):
        began = time.time()
        if conf.force_index_from_scratch or not exists(spark, f"{at}/manifest/_SUCCESS"):
            nodes, edges = pipeline.build(data["passages"], conf)
            store.save_tree(nodes, edges, at, conf.tree_save_chunk_size)
            sparse = pipeline.sparse_index(nodes, conf)
            if sparse is not None:
                store.save_index(sparse, f"{at}/sparse")
        times["build"] = round(time.time() - began, 3)
    if what in ("answer", "all") and (conf.force_qa_from_scratch or store.load_results(spark, results) is None):
        began = time.time()
        nodes, edges = store.load_tree(spark, at)
        sparse = store.load_index(spark, f"{at}/sparse") if conf.hybrid_search and exists(spark, f"{at}/sparse/scopes/_SUCCESS") else None
        answers, rounds = pipeline.answered(nodes, edges, pipeline.routed(data["queries"], data["passages"], conf), conf, sparse)
        if rounds is not None:
            agent.final_documents(rounds).write.mode("overwrite").parquet(f"{results}/documents")
        store.save_results(answers, results, {"conf": repr(conf), "time": times | {"answer": round(time.time() - began, 3)}})
    if what in ("score", "all"):
        found = store.load_results(spark, results)
        gold = data["gold"].select("query_id", F.explode("answers").alias("answer"))
        looked, wanted = None, data["gold"].select("query_id", F.explode("documents").alias("text"))
        if exists(spark, f"{results}/documents/_SUCCESS") and not wanted.isEmpty():
            looked = spark.read.parquet(f"{results}/documents").select("query_id", F.posexplode("documents").alias("rank", "text")).withColumn("rank", F.col("rank") + 1)
        print(evaluate.evaluate(found.select("query_id", F.col("answer").alias("prediction")), gold, looked, wanted if looked is not None else None, metrics=conf.evaluation_metrics))
    if what == "ask":
        print(ask(spark, conf, at, str(question), tree_id or 0, update))
    if what == "chat":
        turns: list[tuple[str, str]] = []
        while (line := input("> ").strip()) and line not in ("quit", "exit"):
            said = ask(spark, conf, at, history_text(turns, line), tree_id or 0, True)
            print(said)
            turns += [("user", line), ("assistant", said)]
    if what == "inspect":
        nodes, edges = store.load_tree(spark, at)
        if tree_id is not None:
            nodes, edges = nodes.where(F.col("tree_id") == tree_id), edges.where(F.col("tree_id") == tree_id)
        if layer is not None or node is not None:
            report = inspect.node_report(nodes, edges)
            report.where(F.col("depth") == layer if layer is not None else F.col("node_id") == node).orderBy("tree_id", "node_id").show(200, False)
            return 0
        inspect.layer_counts(nodes).orderBy("tree_id", "layer").show(200, False)
        inspect.child_stats(edges).orderBy("tree_id").show(200, False)
        inspect.node_report(nodes, edges).orderBy("tree_id", "depth", "node_id").show(200, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
