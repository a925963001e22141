"""Source trees in a directory.

Only paths are listed on the driver, with excluded directories never entered; contents are read by the executors that parse
them, one partition for each few megabytes.  A file that cannot be read is a row with ``read_error``, and the scan goes on.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.families import SUFFIXES
from ..functions.globs import glob_regex, pruned_directories

LISTING = "path string, size long, language string, is_symlink boolean, git_ignored boolean"


def language_of(path: str) -> str | None:
    return SUFFIXES.get(os.path.splitext(path)[1].casefold())


def resolve_languages(names: list[str] | tuple[str, ...]) -> set[str]:
    """Language ids for names given as ids (any case) or suffixes; an unknown name is an error."""
    ids, out = {*SUFFIXES.values()}, set()
    for name in names:
        found = {i for i in ids if i.casefold() == name.casefold()} or {SUFFIXES[s] for s in (name.casefold(), f".{name.casefold()}") if s in SUFFIXES}
        if len(found) != 1:
            raise ValueError(f"unknown or ambiguous language: {name}")
        out |= found
    return out


def _git(root: Path, *args: str) -> list[str] | None:
    run = subprocess.run(["git", "-C", str(root), *args], capture_output=True, check=False)
    return [p for p in run.stdout.decode("utf-8", "surrogateescape").split("\0") if p] if run.returncode == 0 else None


def git_state(root: Path) -> tuple[set[str], set[str]] | None:
    """Eligible files, and outermost ignored directories and files; null outside a repository.  What is tracked wins."""
    eligible = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    ignored = _git(root, "ls-files", "-z", "--others", "--ignored", "--exclude-standard", "--directory")
    return None if eligible is None or ignored is None else ({*eligible}, {p.rstrip("/") for p in ignored})


def list_files(root: str | Path, exclusions: tuple[str, ...] = (), *, use_git: bool = True) -> tuple[list[tuple], list[tuple[str, str]]]:
    """Rows of ``LISTING`` in path order, and directories left out with the reason.  Links are not followed."""
    root = Path(root)
    if not root.is_dir():
        raise NotADirectoryError(root)
    cut = [re.compile(glob_regex(p)) for p in pruned_directories(exclusions)]
    git = git_state(root) if use_git else None
    rows, left_out, pending = [], [], [""]
    while pending:
        at = pending.pop()
        with os.scandir(root / at) as entries:
            for e in entries:
                path = f"{at}/{e.name}" if at else e.name
                if e.is_dir(follow_symlinks=False):
                    if e.name == ".git":
                        continue
                    if any(c.match(path) for c in cut):
                        left_out.append((path, "configured exclusion"))
                    elif git and path in git[1]:
                        left_out.append((path, "git ignored"))
                    elif e.is_junction():
                        left_out.append((path, "symlink"))
                    else:
                        pending.append(path)
                elif e.is_symlink() and Path(e.path).is_dir():
                    left_out.append((path, "symlink"))
                else:
                    size = 0 if e.is_symlink() else e.stat(follow_symlinks=False).st_size
                    rows.append((path, size, language_of(path), e.is_symlink(), bool(git) and path not in git[0]))
    return sorted(rows), sorted(left_out)


def read_directory(spark: SparkSession, root: str | Path, exclusions: tuple[str, ...] = (), *, languages: set[str] | None = None, use_git: bool = True, partition_bytes: int = 4_000_000) -> DataFrame:
    """Inventory of a directory that driver and executors can both see: ``LISTING`` with ``content`` and ``read_error``.

    Files of languages that were not asked for are dropped before any byte is read, and counted nowhere.
    """
    rows, _ = list_files(root, exclusions, use_git=use_git)
    if languages is not None:
        rows = [r for r in rows if r[2] is None or r[2] in languages]
    parts = max(1, min(len(rows), -(-sum(r[1] for r in rows) // partition_bytes)))
    listing = spark.createDataFrame(rows, LISTING).repartition(parts, "path")
    base = str(Path(root).resolve())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 100):
                batch = whole.slice(at, 100)
                content, errors = [], []
                for path, link in zip(batch.column("path").to_pylist(), batch.column("is_symlink").to_pylist(), strict=True):
                    data = error = None
                    if not link:
                        try:
                            data = Path(base, path).read_bytes()
                        except OSError as e:
                            error = f"{type(e).__name__}: {e.strerror}"
                    content.append(data)
                    errors.append(error)
                columns = [batch.column(n) for n in ("path", "size", "language", "is_symlink", "git_ignored")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["path", "size", "language", "is_symlink", "git_ignored", "content", "read_error"])

    return listing.mapInArrow(read, f"{LISTING}, content binary, read_error string")


def read_store(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    """Source files of any store that Spark reads: ``path`` (below the root), ``content``, ``language``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    language = F.lit(None).cast("string")
    for s, name in SUFFIXES.items():
        language = F.when(suffix == s, name).otherwise(language)
    rest = F.regexp_replace("path", f"^.*?{re.escape(path.rstrip('/').split('://')[-1])}/", "")
    return files.select(rest.alias("path"), F.col("length").alias("size"), language.alias("language"), F.lit(False).alias("is_symlink"), F.lit(False).alias("git_ignored"), "content", F.lit(None).cast("string").alias("read_error"))
