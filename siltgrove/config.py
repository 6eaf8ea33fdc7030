"""Settings of a run: defaults, then a file of overrides, then the command line; never changed afterwards."""

from __future__ import annotations

import ast
import importlib.util
import re
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """All settings with their defaults."""

    dataset: str = "corpus"
    data_dir: str = "./data"
    local_pdf: str | None = None
    pdf_batch_size: int = 1
    test_samples: int = -1
    force_split: bool = False
    max_tokens_per_chunk: int = 100
    embedder: str = "hashing"
    reader: str = "extractive"
    reranker: str = "overlap"
    embedding_width: int = 64
    tree_builder: str = "exact"
    passage_as_tree: bool = False
    reorganize_leaf: bool = False
    max_num_children: int = 40
    bucket_size: int | None = None
    bucket_max_fanout: int = 32
    bucket_sample_size: int = 8192
    bucket_kmeans_iters: int = 5
    tree_save_chunk_size: int = 200_000
    knn: int = 32
    exclude_abs: bool = False
    abstract_type: str = "summary"
    max_abs_length: int = 100
    abstract_layer_as_context: int = 0
    force_index_from_scratch: bool = False
    answer_type: str = "short"
    no_retrieval: bool = False
    max_retrieval_time: int | str = 3
    hop_model: str | None = None
    max_response_length: int = 500
    force_qa_from_scratch: bool = False
    selection_mode: str = "top_k"
    tree_top_k: int = 5
    threshold: float = 0.5
    start_layer: int | None = None
    distance: str = "cosine"
    hybrid_search: bool = False
    sparse_top_k: int = 5
    rrf_k: int = 60
    rerank: bool = False
    rerank_top_k: int = 5
    evaluation_metrics: str = "all"
    save_dir: str = "./output"
    log_path: str = "./log"
    verbose: bool = False

    def __post_init__(self) -> None:
        for name, allowed in (("tree_builder", ("exact", "knn")), ("abstract_type", ("summary", "keyword")), ("answer_type", ("short", "medium", "long", "auto")), ("selection_mode", ("top_k", "threshold")), ("distance", ("cosine", "l1", "l2", "linf"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.max_retrieval_time != "auto" and not isinstance(self.max_retrieval_time, int):
            raise ValueError("max_retrieval_time must be a number or auto")
        if self.max_retrieval_time == "auto" and not self.hop_model:
            raise ValueError("max_retrieval_time auto needs hop_model, the folder of a trained hop model")


def literal(text: str) -> object:
    """A command-line value: a Python literal if it is one, else the text."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def overrides(args: list[str]) -> dict[str, object]:
    """`--key value`, `--key=value` and bare `--flag` as a dict; unknown keys and stray words raise."""
    known = {f.name for f in fields(Config)}
    out: dict[str, object] = {}
    k = 0
    while k < len(args):
        if not args[k].startswith("--"):
            raise ValueError(f"unexpected argument: {args[k]}")
        name, eq, value = args[k][2:].partition("=")
        if name not in known:
            raise ValueError(f"unknown setting: {name}")
        if eq:
            out[name] = literal(value)
        elif k + 1 < len(args) and not args[k + 1].startswith("--"):
            k += 1
            out[name] = literal(args[k])
        else:
            out[name] = True
        k += 1
    return out


def load(path: str | None = None, args: list[str] | None = None) -> Config:
    """Defaults, then the `conf` dict of a Python file, then the command line's overrides."""
    found: dict[str, object] = {}
    if path:
        spec = importlib.util.spec_from_file_location("siltgrove_settings", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        found = dict(module.conf)
        if bad := set(found) - {f.name for f in fields(Config)}:
            raise ValueError(f"unknown settings: {sorted(bad)}")
    return replace(Config(), **found, **{}) if not args else replace(replace(Config(), **found), **overrides(args))


def artefact(conf: Config) -> str:
    """The name of a saved index: dataset, embedder, abstracts, builder and bucketing."""
    parts = [conf.dataset, conf.embedder, "none" if conf.exclude_abs else conf.abstract_type, *([] if conf.tree_builder == "exact" else [conf.tree_builder]), *(["bucketed"] if conf.bucket_size else []), "tree"]
    return re.sub(r"[ .]+$", "", re.sub(r"\s+", " ", re.sub(r'[<>:"/\\|?*]', "_", "_".join(parts))))
