"""PDF folders: listing, archives, a cache of parsed files, and the seam for a parser."""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import item_text
from ..session import exists

MODES = ("file", "dir", "dir_recursive", "package", "package_recursive")
CACHE = "_parsed"


def unpack(archive: str, to: str) -> str:
    """A zip or tar archive unpacked below a folder. Members that would land outside it, links and devices raise."""
    root = Path(to).resolve()
    root.mkdir(parents=True, exist_ok=True)

    def safe(name: str) -> None:
        if not (root / name).resolve().is_relative_to(root):
            raise ValueError(f"unsafe path in archive: {name}")

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for m in z.infolist():
                safe(m.filename)
                if (m.external_attr >> 16) & 0o170000 == 0o120000:
                    raise ValueError(f"link in archive: {m.filename}")
            z.extractall(root)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            for m in t.getmembers():
                safe(m.name)
                if not (m.isfile() or m.isdir()):
                    raise ValueError(f"link in archive: {m.name}")
            t.extractall(root, filter="data")
    elif archive.lower().endswith((".7z", ".rar")):
        _other(archive, root, safe)
    else:
        raise ValueError(f"unsupported archive: {archive}")
    return str(root)


def _other(archive: str, root: Path, safe: Callable[[str], None]) -> None:
    """7z and rar, where the modules that read them are installed."""
    name = "py7zr" if archive.lower().endswith(".7z") else "rarfile"
    try:
        module = __import__(name)
    except ImportError:
        raise ValueError(f"unsupported archive without the module {name}: {archive}") from None
    with (module.SevenZipFile(archive) if name == "py7zr" else module.RarFile(archive)) as a:
        for member in a.getnames() if name == "py7zr" else a.namelist():
            safe(member)
        a.extractall(root)
    for p in root.rglob("*"):
        if p.is_symlink():
            p.unlink()
            raise ValueError(f"link in archive: {p.name}")


def listing(path: str, mode: str) -> list[str]:
    """The PDF files of a path, sorted; the cache's folder is left out. An archive of the package modes is unpacked
    beside it first, into a folder of its name without the ending."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "file":
        if not path.lower().endswith(".pdf"):
            raise ValueError("not a PDF file")
        return [path]
    if mode.startswith("package") and Path(path).is_file():
        path = unpack(path, str(Path(path).with_suffix("")))
    walk = Path(path).rglob("*") if mode.endswith("recursive") else Path(path).glob("*")
    return sorted(str(p) for p in walk if p.is_file() and p.suffix.lower() == ".pdf" and CACHE not in p.parts)


def read_bytes(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length and content of the PDF files of a folder, read in the executors."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower()).load(path)


def parse(files: DataFrame, parser: Callable[[bytes], list[str]], cache: str | None = None) -> DataFrame:
    """title and chunks of each file: from the cache where it has the path, else by the parser, whose results are
    added to the cache. A file that won't parse has null chunks."""
    spark = files.sparkSession

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> list[str] | None:
            try:
                return parser(bytes(b))
            except Exception:  # noqa: BLE001
                return None

        return s.map(one)

    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "(?i)\\.pdf$", "")
    have = spark.read.parquet(cache) if cache and exists(spark, f"{cache}/_SUCCESS") else None
    missing = files if have is None else files.join(have.select("path"), "path", "left_anti")
    fresh = missing.select("path", title.alias("title"), run("content").alias("chunks"))
    if not cache:
        return fresh.select("title", "chunks")
    fresh.where("chunks is not null").write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(files.select("path"), "path", "left_semi").select("title", "chunks")


ITEM_FIELDS = ("text", "latex", "html", "code_caption", "code_body", "table_caption", "table_body", "table_footnote", "image_caption", "chart_caption", "content")
ITEMS = "type string, text_level int, page_idx int, list_items array<string>, " + ", ".join(f"{c} string" for c in ITEM_FIELDS)


def content_list(spark: SparkSession, path: str) -> DataFrame:
    """path, item_no (from 0) and text of the items of parsed PDFs whose content lists (JSON arrays of items) lie at a
    path or pattern; items without text, page furniture among them, are left out. A file that is no list gives none."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", f"array<struct<{_as_struct(ITEMS)}>>").alias("items"))
    rows = files.select("path", F.posexplode("items").alias("item_no", "x")).select("path", "item_no", "x.*")
    return rows.select("path", "item_no", item_text(F.col("type"), F.col).alias("text")).where("text <> ''")


def _as_struct(fields: str) -> str:
    """Column definitions as those of a struct."""
    return ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))


def markdown_chunks(text):  # noqa: ANN001, ANN201
    """The blocks of a Markdown text between empty lines, as a Column."""
    return F.filter(F.transform(F.split(text, "\\n\\s*\\n"), F.trim), lambda s: s != "")
