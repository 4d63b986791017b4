"""Files, repositories and downloads as DataFrames; paths and logs."""

from __future__ import annotations

import json
import logging
import os
import re
import subprocess
import sys
import tempfile
import time
import urllib.request
from contextlib import contextmanager
from datetime import UTC, datetime
from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import values as V
from docloom.functions.text import basename, extension, post_process
from docloom.schemas import FileError


def read_files(spark: SparkSession, path: str | list[str], max_mb: int = 1024, recursive: bool = True, supported_only: bool = False) -> DataFrame:
    """(file_path, file_name, file_extension, file_size, last_modified, is_text, status, content) of files.

    Files over max_mb keep their row with status 'too large' and null content; empty ones have status 'empty'. The size is
    judged by the listing before any content is decoded. content is after the treatment of its extension.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    p = F.regexp_replace("path", "^file:(//)?", "")
    big = F.col("length") > max_mb * 1048576
    df = raw.select(p.alias("file_path"), basename(p).alias("file_name"), extension(p).alias("file_extension"), F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"), (F.col("length") < 102400).alias("is_text"), F.when(big, "too large").when(F.col("length") == 0, "empty").otherwise("ok").alias("status"), F.when(~big, F.decode("content", "UTF-8")).alias("_raw"))
    if supported_only:
        df = df.where(F.col("file_extension").isin(V.SUPPORTED_EXT))
    return df.withColumn("content", post_process(F.col("_raw"), F.col("file_extension"))).drop("_raw")


def glob_column(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the glob patterns, where ** spans directories."""
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def glob_regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def pack_repository(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(file_path, content, packed) of a repository's files that match include and not exclude, each as one section of the
    packed document. Sections stay rows; write_pack puts them into one file in order of path."""
    rel = F.regexp_replace("file_path", "^" + re.escape(root.rstrip("/")) + "/", "")
    df = read_files(spark, root).withColumn("relative", rel)
    df = df.where(glob_column(F.col("relative"), include or V.REPO_INCLUDE) & ~glob_column(F.col("relative"), [*(exclude or []), *V.REPO_EXCLUDE]))
    return df.select(F.col("relative").alias("file_path"), "content", F.concat(F.lit("## File: "), F.col("relative"), F.lit("\n````\n"), F.coalesce("content", F.lit("")), F.lit("\n````\n")).alias("packed"))


def write_pack(packed: DataFrame, target: str) -> str:
    """Writes the sections in order of path to one markdown file, streaming them through the driver."""
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    with open(target, "w", encoding="utf-8") as f:
        for r in packed.orderBy("file_path").select("packed").toLocalIterator():
            f.write(r["packed"] + "\n")
    return target


def is_access_error(message: str) -> bool:
    return any(x in message.lower() for x in V.ACCESS_ERRORS)


def clone_repository(url: str, branch: str | None = None) -> str:
    """A shallow clone in a temporary directory; arguments are a list, never a shell's text."""
    to = tempfile.mkdtemp(prefix="clone-")
    run = subprocess.run(["git", "clone", "--depth", "1", *(["--branch", branch] if branch else []), "--", url, to], capture_output=True, text=True, timeout=600)
    if run.returncode:
        raise FileError(run.stderr.strip()[-500:])
    return to


def absolute_path(path: str) -> str:
    """A path from the root, without '.', '..' and doubled slashes."""
    return os.path.abspath(path)


def safe_filename(name: str) -> str:
    s = re.sub("_{2,}", "_", re.sub("[^a-zA-Z0-9._-]", "_", name))
    return re.sub("^_+|_+$", "", s)[:255]


def download(url: str, filename: str, folder: str, overwrite: bool = True, max_mb: int = 1024, timeout: int = 30, progress=None) -> str:
    """Fetches a text file into folder; only status 200 is taken, and no more than max_mb."""
    target = Path(folder) / safe_filename(filename)
    if target.exists() and not overwrite:
        raise FileError(f"{target} exists")
    with urllib.request.urlopen(url, timeout=timeout) as r:
        if getattr(r, "status", 200) not in (200, None):
            raise FileError(f"status {r.status}")
        size, got, parts = int(r.headers.get("content-length") or 0), 0, []
        while block := r.read(1 << 16):
            got += len(block)
            if got > max_mb * 1048576:
                raise FileError(f"over {max_mb} MB")
            parts.append(block)
            if progress and size:
                progress(100 * got / size)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(b"".join(parts).decode("utf-8", "replace"), encoding="utf-8")
    return str(target)


def data_folder() -> Path:
    """The folder for data: environment, else the system's usual place."""
    if named := os.environ.get("DOCLOOM_DATA_FOLDER"):
        return Path(named)
    home = Path.home()
    if sys.platform == "darwin":
        return home / "Library/Application Support/docloom"
    if os.name == "nt":
        return Path(os.environ.get("APPDATA", home / "AppData/Roaming")) / "docloom"
    return Path(os.environ.get("XDG_DATA_HOME", home / ".local/share")) / "docloom"


def docs_folder() -> Path:
    return Path(os.environ.get("DOCLOOM_DOCS_FOLDER") or data_folder() / "docs")


def make_folders(root: Path) -> dict[str, Path]:
    out = {n: root / n for n in ("repositories", "fetched", "temp")}
    for p in out.values():
        p.mkdir(parents=True, exist_ok=True)
    return out


def matches_any(path: str, patterns: list[str]) -> bool:
    return any(fnmatch(path, p) for p in patterns)


class JsonLines(logging.Handler):
    """A log handler that appends one JSON object a line; read it back with read_log."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def emit(self, record: logging.LogRecord) -> None:
        row = {"timestamp": datetime.now(UTC).isoformat(), "level": record.levelname, "message": record.getMessage(), "context": json.dumps(getattr(record, "context", None), default=str), "error": str(record.exc_info[1]) if record.exc_info else None}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp timestamp, level string, message string, context string, error string").json(path)


@contextmanager
def timed(log: logging.Logger, label: str):
    began = time.time()
    try:
        yield
    finally:
        log.info("%s took %.0f ms", label, (time.time() - began) * 1000)
