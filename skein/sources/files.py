"""Finding and reading files."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes that can be read, and directories that are never entered.
SUFFIXES = (".txt", ".md", ".pdf", ".pptx")
SKIPPED = (".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "node_modules", "build", "dist")
MAX_JSON = 512 << 20
FIRST_BLOCK = 64 << 10


def normal_rule(rule: str) -> str:
    rule = rule.replace("\\", "/")
    return rule.removeprefix("./").rstrip("/") or "/"


def excluded(directory: Path, root: Path, rules: Iterable[str]) -> bool:
    """Whether a rule names the directory, matches its name or its path from the root, or lies above it."""
    whole, inner = str(directory), directory.relative_to(root).as_posix() if directory != root else ""
    for rule in rules:
        low = rule.casefold()
        if os.path.isabs(rule):
            if whole == rule or whole.startswith(rule.rstrip("/") + "/"):
                return True
        elif any(fnmatch.fnmatchcase(x.casefold(), low) for x in (directory.name, inner, inner + "/") if x):
            return True
    return False


def discover(inputs: Iterable[str], *, include_json: bool = False, exclude_dirs: Iterable[str] = (), exclude_files: Iterable[str] = (), max_files: int | None = None) -> Iterator[str]:
    """Absolute paths in walking order: a directory's files by name, then its directories. Overlapping inputs give each
    file once; a missing input gives none; 0 or None is no limit."""
    if max_files is not None and max_files < 0:
        raise ValueError("the number of files must not be negative")
    rules = [normal_rule(r) for r in (*SKIPPED, *exclude_dirs)]
    hidden, seen = {str(Path(p).expanduser().resolve()) for p in exclude_files}, set()
    kinds = (*SUFFIXES, ".json") if include_json else SUFFIXES

    def walk() -> Iterator[Path]:
        for one in inputs:
            root = Path(one).expanduser().resolve()
            if root.is_file():
                yield root
            elif root.is_dir() and not excluded(root, root, rules):
                for place, dirs, names in os.walk(root):
                    dirs[:] = sorted(d for d in dirs if not excluded(Path(place, d), root, rules))
                    yield from (Path(place, n) for n in sorted(names))

    for path in walk():
        own = str(path.resolve())
        if path.suffix.lower() in kinds and own not in hidden and own not in seen:
            seen.add(own)
            yield own
            if max_files and len(seen) >= max_files:
                return


def scan(spark: SparkSession, paths: list[str], *, fingerprint: str = "", max_json: int = MAX_JSON) -> DataFrame:
    """ordinal, path, filename, file_type, size, modified_ns, status ('oversized' JSON is told by size, before any content
    is read), and content, sha256 of the rest."""
    if not paths:
        return spark.createDataFrame([], "ordinal long, path string, filename string, file_type string, size long, modified_ns long, parser_fingerprint string, status string, sha256 string, content binary")
    order = spark.createDataFrame(list(enumerate(paths)), "ordinal long, path string")
    files = spark.read.format("binaryFile").load(paths).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    big = (kind == "json") & (F.col("length") > max_json) & F.lit(max_json > 0)
    content = F.when(~F.col("big"), F.col("content"))
    df = files.withColumn("big", big).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), kind.alias("file_type"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.lit(fingerprint).alias("parser_fingerprint"), F.when(F.col("big"), "oversized").otherwise("found").alias("status"), F.sha2(content, 256).alias("sha256"), content.alias("content"))
    return order.join(df, "path")


def decode(data: bytes) -> str:
    """The first block settles the encoding: UTF-8 (a byte-order mark goes), else GB 18030, else UTF-8; what does not fit is replaced."""
    import codecs

    first = data[:FIRST_BLOCK]
    for name in ("utf-8-sig", "gb18030"):
        try:
            codecs.getincrementaldecoder(name)("strict").decode(first, final=len(data) <= FIRST_BLOCK)
            return data.decode(name, "replace")
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def pdf_text(data: bytes) -> str:
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("reading PDF needs the package pypdf") from None
    pages = []
    for page in PdfReader(io.BytesIO(data)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001  one bad page does not lose the file
            continue
    return "".join(p + "\n\n" for p in pages if p)


def pptx_text(data: bytes) -> str:
    import io

    try:
        from pptx import Presentation
    except ImportError:
        raise ValueError("reading PPTX needs the package python-pptx") from None

    def texts(shapes) -> Iterator[str]:
        for shape in shapes:
            if hasattr(shape, "shapes"):
                yield from texts(shape.shapes)
            elif getattr(shape, "has_table", False):
                yield from ("\t".join(t for c in row.cells if (t := c.text.strip())) for row in shape.table.rows)
            elif getattr(shape, "has_text_frame", False) and shape.text_frame.text.strip():
                yield shape.text_frame.text.strip()

    slides = Presentation(io.BytesIO(data)).slides
    return "".join(f"[Slide {n}]\n" + "\n".join(t for t in texts(s.shapes) if t) + "\n\n" for n, s in enumerate(slides, 1))


READERS = {"txt": decode, "md": decode, "json": lambda data: data.decode("utf-8-sig"), "pdf": pdf_text, "pptx": pptx_text}


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def read_text(content: pd.Series, file_type: pd.Series) -> pd.DataFrame:
    """A file's text, or why it has none; a fault stays with its file."""

    def one(data: bytes | None, kind: str) -> tuple[str | None, str | None]:
        if data is None:
            return None, None
        try:
            return READERS[kind](data), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    rows = [one(c, k) for c, k in zip(content, file_type, strict=True)]
    return pd.DataFrame(rows, columns=["text", "error"])


def audit_records(spark: SparkSession, path: str, marker: str, schema: str) -> DataFrame:
    """record_no and the payload of every log line that holds the marker."""
    lines = spark.read.text(path).where(F.col("value").contains(marker)).withColumn("record_no", F.monotonically_increasing_id())
    return lines.select("record_no", F.from_json(F.element_at(F.split("value", marker, 2), 2), schema).alias("r")).select("record_no", "r.*")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of `datasets` in a JSON file."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("datasets").alias("d")).select("d.*")
