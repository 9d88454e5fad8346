"""Git repositories as a Spark data source: working tree, staged files, one commit, or all history.

    spark.dataSource.register(GitSource)
    spark.read.format("git").option("mode", "history").load("/path/to/repo")

The driver lists paths, or for the history commits only; what a commit changed is listed by the
tasks, a partition per group of commits or objects, each through one ``diff-tree`` and two
``cat-file`` processes, of which one tells sizes, so that no oversize blob is read. The repository
has to be readable where tasks run.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES = 20 * 1024 * 1024
HEAD_BYTES = 8000
GROUP = 500
SCHEMA = "artifact_id string, source_type string, uri string, path string, commit_sha string, content binary"


def check_ref(ref: str) -> str:
    """A ref that cannot be taken for an option."""
    if not ref or ref.startswith("-"):
        raise ValueError(f"bad ref {ref!r}")
    return ref


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def _names(raw: bytes) -> list[str]:
    return [x.decode("utf-8", "surrogateescape") for x in raw.split(b"\0") if x]


@dataclass
class Group(InputPartition):
    #: (path, object or empty for the working tree, commit)
    entries: list
    #: commits whose changes are read instead
    commits: tuple = ()


def listing(repo: str, mode: str, ref: str = "HEAD") -> list[tuple[str, str, str]]:
    """What to read: (path, object name, commit)."""
    if mode == "working_tree":
        return [(p, "", "") for p in _names(_git(repo, "ls-files", "-z", "--cached", "--others", "--exclude-standard"))]
    if mode == "staged":
        changed = _names(_git(repo, "diff", "--cached", "--name-only", "-z", "--diff-filter=ACMR"))
        return [(p, f":{p}", "") for p in changed]
    if mode == "commit":
        sha = _git(repo, "rev-parse", "--verify", check_ref(ref) + "^{commit}").decode().strip()
        out = []
        for entry in _names(_git(repo, "ls-tree", "-r", "-z", sha)):
            meta, path = entry.split("\t", 1)
            if meta.split()[1] == "blob":
                out.append((path, meta.split()[2], sha))
        return out
    raise ValueError(f"unknown mode {mode!r}")


def changed(repo: str, commits: Sequence[str]) -> Iterator[tuple[str, str, str]]:
    """(path, object name, commit) of the plain files that each commit added or changed, by one process."""
    run = subprocess.run(["git", "-C", repo, "diff-tree", "--stdin", "--root", "-r", "-z", "--no-renames"], input="\n".join(commits).encode() + b"\n", check=True, capture_output=True)
    commit, meta = "", None
    for part in run.stdout.split(b"\0"):
        if meta is not None:
            if meta[4] != "D" and meta[1].startswith("100"):
                yield part.decode("utf-8", "surrogateescape"), meta[3], commit
            meta = None
        elif part.startswith(b":"):
            meta = part[1:].decode().split()
        elif part.strip():
            commit = part.decode().strip()


class _Blobs:
    """Objects of a repository by name, read only if they are small enough."""

    def __init__(self, repo: str, max_bytes: int) -> None:
        self.most = max_bytes
        self.ask, self.get = (subprocess.Popen(["git", "-C", repo, "cat-file", how], stdin=subprocess.PIPE, stdout=subprocess.PIPE) for how in ("--batch-check", "--batch"))

    def _head(self, process: subprocess.Popen, name: str) -> list[bytes]:
        process.stdin.write(name.encode("utf-8", "surrogateescape") + b"\n")
        process.stdin.flush()
        return process.stdout.readline().split()

    def read(self, name: str) -> bytes | None:
        head = self._head(self.ask, name)
        if len(head) < 3 or head[-2] != b"blob" or int(head[-1]) > self.most:
            return None
        size = int(self._head(self.get, name)[-1])
        data = self.get.stdout.read(size)
        self.get.stdout.read(1)
        return data

    def close(self) -> None:
        for p in (self.ask, self.get):
            p.stdin.close()
            p.wait()


class GitReader(DataSourceReader):
    def __init__(self, repo: str, mode: str, ref: str, max_bytes: int) -> None:
        self.repo, self.mode, self.ref, self.max_bytes = repo, mode, ref, max_bytes

    def partitions(self) -> list[Group]:
        if self.mode == "history":
            commits = _git(self.repo, "rev-list", "--all", "--reverse").decode().split()
            return [Group([], tuple(commits[i : i + GROUP])) for i in range(0, len(commits), GROUP)] or [Group([])]
        found = listing(self.repo, self.mode, self.ref)
        return [Group(found[i : i + GROUP]) for i in range(0, len(found), GROUP)] or [Group([])]

    def read(self, partition: Group) -> Iterator[tuple]:
        import hashlib
        import os

        kind = {"working_tree": "git_working_tree", "staged": "git_staged"}.get(self.mode, "git_commit")
        blobs = None
        try:
            for path, obj, commit in changed(self.repo, partition.commits) if partition.commits else partition.entries:
                if not obj:
                    full = os.path.join(self.repo, path)
                    if os.path.islink(full) or not os.path.isfile(full) or os.path.getsize(full) > self.max_bytes:
                        continue
                    with open(full, "rb") as f:
                        data = f.read()
                else:
                    blobs = blobs or _Blobs(self.repo, self.max_bytes)
                    data = blobs.read(obj)
                if data is None or b"\0" in data[:HEAD_BYTES]:
                    continue
                shown = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                ident = hashlib.sha256(f"{kind}|{commit}|{shown}".encode()).hexdigest()
                yield (ident, kind, self.repo, shown, commit, data)
        finally:
            if blobs is not None:
                blobs.close()


class GitSource(DataSource):
    """Options: ``path`` (or load argument), ``mode`` (working_tree, staged, commit, history), ``ref``, ``maxBytes``."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitReader:
        o = self.options
        return GitReader(o["path"], o.get("mode", "working_tree"), o.get("ref", "HEAD"), int(o.get("maxbytes", o.get("maxBytes", MAX_BYTES))))
