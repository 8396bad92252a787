"""Building and maintaining the index of a source tree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import paths
from ..operators import chunking, delta, embed
from ..sources import git, tree
from ..sources.scratch import cut
from ..sources.store import Store


@dataclass
class Change:
    added: int = 0
    updated: int = 0
    removed: int = 0
    failed: int = 0
    head_changed: bool = False
    #: Whether a file of the context is among those that changed.
    context_changed: bool = False

    @property
    def any(self) -> bool:
        return bool(self.added or self.updated or self.removed)


class Index:
    def __init__(self, spark: SparkSession, settings: Settings, factory: Callable | None = None):
        self.spark, self.settings = spark, settings
        self.factory = factory or (lambda dim=settings.embedding_dim: embed.hashed_ngrams(dim))
        self.store = Store(spark, str(settings.store_path))
        self._entries: DataFrame | None = None

    def entries(self) -> DataFrame:
        return tree.listing(self.spark, self.settings.repo_path)

    def platform(self) -> dict:
        """type, languages, extensions of the tree: one small row."""
        return tree.platform(self.entries()).first().asDict()

    def modules(self) -> DataFrame:
        return tree.build_modules(self.entries())

    def scoped(self, files: DataFrame) -> DataFrame:
        return files.where(paths.in_scope(F.col("file_path"), self.settings.exclude_prefixes, self.settings.include_prefixes))

    def processed(self, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(parsed, chunks with vectors, registry) of files."""
        parsed = tree.parse(files)
        chunks = embed.embed_chunks(chunking.chunk_files(parsed, self.settings), self.factory, self.settings.embedding_batch_size)
        registry = tree.nearest_module(tree.with_hash(files.where(paths.extension(F.col("file_path")).isin([e for x in tree.EXTENSIONS.values() for e in x]))).select("file_path", "content_hash", "line_count"), self.modules())
        return parsed, chunks, registry

    def refresh(self, only: list[str] | None = None, context: list[str] | None = None) -> Change:
        """Brings the store up to date: a full comparison by hashes, or of the paths in `only`."""
        extensions = self.platform()["extensions"]
        head, before = git.head(self.settings.repo_path), self.store.manifest()
        change = Change(head_changed=head != before["commit"])
        # hashes of all files; the contents of those that changed are read again
        current = self.scoped(tree.with_hash(tree.read_tree(self.spark, self.settings.repo_path, extensions, only)))
        stored = self.store.read("registry")
        if only is not None:
            stored = stored.where(F.col("file_path").isin(only))
        ops = delta.diff(current, stored)
        counts = {r.op: r.n for r in ops.groupBy("op").agg(F.count("*").alias("n")).collect()}
        change.added, change.updated, change.removed = (counts.get(k, 0) for k in ("add", "update", "remove"))
        if not change.any and before["version"]:
            if change.head_changed:
                self.store.mark(commit=head)
            return change
        touched = cut(ops.where("op <> 'keep'"), "touched")
        if context:
            change.context_changed = bool(touched.where(F.col("file_path").isin(context)).limit(1).count())
        fresh = current.join(touched.where("op <> 'remove'"), "file_path", "left_semi").select("file_path", "content_bytes", "content")
        parsed, chunks, registry = self.processed(cut(fresh, "fresh"))
        new = {"parsed": parsed, "chunks": chunks, "registry": registry}
        failed = parsed.where("error is not null").select("file_path")
        # failures are few and kept by name, so that the next refresh tries them again
        change_failed = sorted(r.file_path for r in failed.collect())
        new["registry"] = registry.where(~F.col("file_path").isin(change_failed)) if change_failed else registry
        dirty = git.dirty(self.settings.repo_path, extensions, self.settings) if self.settings.reindex_dirty else []
        self.store.change(new, touched, commit=head, dirty=dirty, failed=change_failed)
        change.failed = len(change_failed)
        return change

    def ensure_fresh(self, context: list[str] | None = None) -> Change:
        """The cheapest refresh that git allows: nothing at the same commit with the same clean or dirty files, else
        the paths that changed, else all."""
        before, root = self.store.manifest(), self.settings.repo_path
        if not before["version"]:
            return self.refresh(context=context)
        extensions, head = self.platform()["extensions"], git.head(root)
        again = set(before["failed"])
        if self.settings.reindex_dirty:
            # files that were dirty may have been reverted since
            again |= set(git.dirty(root, extensions, self.settings)) | set(before["dirty"])
        if head is None or (head != before["commit"] and before["commit"] is None):
            return self.refresh(context=context)
        if head != before["commit"]:
            moved = git.changed(root, before["commit"], extensions)
            if moved is None:
                return self.refresh(context=context)
            again |= {p for p in moved if git.in_scope(p, self.settings)}
        if not again:
            return Change(head_changed=head != before["commit"])
        return self.refresh(sorted(again), context)
