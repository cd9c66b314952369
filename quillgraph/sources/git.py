"""Repository snapshots through the git program: trees, blobs, commits, first-parent history."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..operators import budget


def _git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], input=stdin, capture_output=True, check=True).stdout


def resolve_commit(repo: str, rev: str) -> str:
    return _git(repo, "rev-parse", "--verify", f"{rev}^{{commit}}").decode().strip()


def head(repo: str) -> str:
    return resolve_commit(repo, "HEAD")


def path_at(repo: str, rev: str, path: str) -> str | None:
    """The blob of a file or symbolic link at a commit; None for folders, submodules and what isn't there."""
    found = _git(repo, "ls-tree", "-z", rev, "--", path).decode("utf-8", "replace")
    for entry in found.split("\0"):
        meta, _, name = entry.partition("\t")
        if name == path and meta.split()[1] == "blob":
            return meta.split()[2]
    return None


def matches(spark: SparkSession, repo: str, tree: DataFrame) -> bool:
    """Does the work tree hold exactly the files of ``tree`` (path, blob)?"""
    from ..operators.deviation import differing_paths

    return not differing_paths(tree, worktree(spark, repo)).limit(1).count()


def read_worktree_file(repo: str, path: str) -> bytes:
    """A file of the work tree as the repository would hold it; of a symbolic link, the target's name.

    CRLF becomes LF where the attributes, or core.autocrlf for files without one, call the file text, and no NUL is in it.
    """
    at = os.path.join(repo, path)
    if os.path.islink(at):
        return os.fsencode(os.readlink(at))
    with open(at, "rb") as f:
        raw = f.read()
    told = _git(repo, "check-attr", "-z", "text", "--", path).decode("utf-8", "replace").split("\0")[2]
    text = told in ("set", "auto") if told != "unspecified" else _config(repo, "core.autocrlf") in ("true", "input")
    return raw.replace(b"\r\n", b"\n") if text and b"\0" not in raw else raw


def _config(repo: str, key: str) -> str:
    got = subprocess.run(["git", "-C", repo, "config", "--get", key], capture_output=True, check=False)
    return got.stdout.decode().strip()


def list_tree(spark: SparkSession, repo: str, rev: str) -> DataFrame:
    """(path, blob) of files and symbolic links at a commit; submodules don't count."""
    rows = []
    for line in _git(repo, "ls-tree", "-r", "-z", rev).decode("utf-8", "replace").split("\0"):
        if line:
            meta, path = line.split("\t", 1)
            _, kind, blob = meta.split()
            if kind == "blob":
                rows.append((path, blob))
    return spark.createDataFrame(rows, "path string, blob string")


def worktree(spark: SparkSession, repo: str) -> DataFrame:
    """(path, blob) of the index's files as they are in the work tree.

    Missing files, submodules and those left out by a sparse checkout are skipped; what git's index knows as unchanged
    keeps its blob, and only the rest is hashed again, links by their target's name.
    """
    kept, again = {}, set()
    for entry in _git(repo, "ls-files", "-s", "-z").decode("utf-8", "surrogateescape").split("\0"):
        meta, _, path = entry.partition("\t")
        if meta and meta.split()[0] != "160000":
            kept[path] = meta.split()[1]
    for entry in _git(repo, "ls-files", "-m", "-z").decode("utf-8", "surrogateescape").split("\0"):
        again.add(entry)
    skipped = {e[2:] for e in _git(repo, "ls-files", "-t", "-z").decode("utf-8", "surrogateescape").split("\0") if e.startswith("S ")}
    rows = []
    for path, blob in kept.items():
        if path in skipped or not os.path.lexists(os.path.join(repo, path)):
            continue
        if path in again:
            blob = _git(repo, "hash-object", "--stdin", "--no-filters", stdin=read_worktree_file(repo, path)).decode().strip()
        rows.append((path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), blob))
    return spark.createDataFrame(rows, "path string, blob string")


def read_blobs(tree: DataFrame, repo: str) -> DataFrame:
    """``tree`` with ``content``: each partition asks one batch process; ``repo`` must be on a folder all executors see."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out, at, content = _git(repo, "cat-file", "--batch", stdin="".join(f"{b}\n" for b in pdf["blob"]).encode()), 0, []
            for _ in range(len(pdf)):
                end = out.index(b"\n", at)
                size = int(out[at:end].split()[-1])
                content.append(out[end + 1 : end + 1 + size])
                at = end + 2 + size
            yield pdf[["path", "blob"]].assign(content=content)

    return tree.select("path", "blob").mapInPandas(run, "path string, blob string, content binary")


def commits(spark: SparkSession, repo: str, rev: str, limit: int = budget.HISTORY) -> DataFrame:
    """(rank, id, first_parent, author_email, author_name, epoch_secs, summary): first-parent ancestry, ``rev`` at rank 0."""
    text = _git(repo, "log", "--first-parent", f"-n{limit}", "--format=%H%x1f%P%x1f%ae%x1f%an%x1f%ct%x1f%s", rev).decode("utf-8", "replace")
    rows = []
    for rank, line in enumerate(x for x in text.split("\n") if x):
        commit, parents, email, name, when, summary = line.split("\x1f")
        rows.append((rank, commit, parents.split()[0] if parents else None, email, name, int(when), summary))
    return spark.createDataFrame(rows, "rank int, id string, first_parent string, author_email string, author_name string, epoch_secs long, summary string")


def changed_in(spark: SparkSession, repo: str, rev: str) -> DataFrame:
    """(path, change) against the first parent; a root commit added all."""
    from ..operators.deviation import differing_paths

    commit = resolve_commit(repo, rev)
    head = list_tree(spark, repo, commit)
    parents = _git(repo, "rev-parse", f"{commit}^@").decode().split()
    base = list_tree(spark, repo, parents[0]) if parents else head.limit(0)
    return differing_paths(base, head)


def checked_in(content, is_text):
    """Work-tree bytes as the repository would hold them: CRLF becomes LF in text, unless a NUL makes it binary."""
    from pyspark.sql import functions as F

    text = F.decode(content, "ISO-8859-1")
    return F.when(is_text & ~F.contains(text, F.lit("\0")), F.encode(F.replace(text, F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")).otherwise(content)
