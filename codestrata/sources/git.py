"""Git commits as sources (A3-A6): trees, blobs, renames and first-parent chains, through a Python data source.

    spark.dataSource.register(GitTree)
    spark.read.format("git_tree").option("root", path).option("revision", "HEAD").load()

The tree is listed once on the driver; each partition reads its blobs through one ``git cat-file --batch`` process.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import language_of

_OBJECT = re.compile(r"[0-9a-f]{40}|[0-9a-f]{64}")
TREE = "path string, size long, language string, is_symlink boolean, git_ignored boolean, content binary, read_error string"


class GitError(RuntimeError):
    pass


def git(root: str, *args: str) -> bytes:
    run = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if run.returncode:
        raise GitError(f"git {args[0]}: {run.stderr.decode('utf-8', 'replace').strip()}")
    return run.stdout


def resolve(root: str, revision: str) -> str:
    """Full object id of a commit."""
    oid = git(root, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()
    if not _OBJECT.fullmatch(oid):
        raise GitError(f"no commit: {revision}")
    return oid


def list_tree(root: str, oid: str) -> list[tuple[str, str, int, bool]]:
    """Path, blob, size, and whether it is a link; submodules are left out, and unknown modes are an error."""
    rows = []
    for entry in git(root, "ls-tree", "-r", "-z", "-l", oid).split(b"\0"):
        if not entry:
            continue
        head, _, path = entry.partition(b"\t")
        mode, _, blob, size = head.decode().split()
        if mode == "160000":
            continue
        if mode not in ("100644", "100755", "120000"):
            raise GitError(f"mode {mode} of {path!r}")
        rows.append((path.decode("utf-8", "surrogateescape"), blob, 0 if size == "-" else int(size), mode == "120000"))
    return sorted(rows)


class _Blobs(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int, bool]]):
        super().__init__(0)
        self.rows = rows


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.oid = options["root"], resolve(options["root"], options.get("revision", "HEAD"))
        self.languages = {x for x in options.get("languages", "").split(",") if x}
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 4_000_000)))

    def partitions(self) -> list[InputPartition]:
        out, rows, size = [], [], 0
        for row in list_tree(self.root, self.oid):
            language = language_of(row[0])
            if self.languages and language is not None and language not in self.languages:
                continue  # before any byte is read
            rows.append(row)
            size += row[2]
            if size >= self.bytes:
                out.append(_Blobs(rows))
                rows, size = [], 0
        return [*out, _Blobs(rows)] if rows or not out else out

    def read(self, partition: _Blobs) -> Iterator[tuple]:
        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as batch:
            for path, blob, size, link in partition.rows:
                content = error = None
                if not link:
                    batch.stdin.write(f"{blob}\n".encode())
                    batch.stdin.flush()
                    head = batch.stdout.readline().split()
                    if len(head) == 3:
                        content = batch.stdout.read(int(head[2]))
                        batch.stdout.read(1)
                    else:
                        error = "missing object"
                yield path, size, language_of(path), link, False, content, error
            batch.stdin.close()


class GitTree(DataSource):
    """Options: ``root``, ``revision`` (HEAD), ``languages`` (ids, comma-separated), ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


def read_commit(spark: SparkSession, root: str, revision: str = "HEAD", **options: str) -> DataFrame:
    spark.dataSource.register(GitTree)
    return spark.read.format("git_tree").options(root=root, revision=revision, **options).load()


def renames(spark: SparkSession, root: str, before: str, after: str) -> DataFrame:
    """``baseline_path, current_path`` of the renames between two commits (copies are no renames)."""
    parts = git(root, "diff", "-M", "--name-status", "-z", resolve(root, before), resolve(root, after)).decode("utf-8", "surrogateescape").split("\0")
    rows, at = [], 0
    while at < len(parts) - 1:
        wide = parts[at][:1] in ("R", "C")
        if parts[at].startswith("R"):
            rows.append((parts[at + 1], parts[at + 2]))
        at += 3 if wide else 2
    return spark.createDataFrame(sorted(rows), "baseline_path string, current_path string")


def commits(spark: SparkSession, root: str, end: str = "HEAD", limit: int = 10_000) -> DataFrame:
    """Raw headers of first-parent commits: ``revision, parent, timestamp`` (committer's); a shallow parent is still named."""
    rows, oid = [], resolve(root, end)
    while oid and len(rows) < limit:
        try:
            text = git(root, "cat-file", "commit", oid).decode("utf-8", "replace")
        except GitError:
            break
        head = text.partition("\n\n")[0].split("\n")
        parent = next((x.split()[1] for x in head if x.startswith("parent ")), None)
        stamp = next(int(x.split()[-2]) for x in head if x.startswith("committer "))
        rows.append((oid, parent, stamp))
        oid = parent
    return spark.createDataFrame(rows, "revision string, parent string, timestamp long")
