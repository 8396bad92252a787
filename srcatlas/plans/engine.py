"""The facade: the questions one can ask of a source tree, as tables and as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import roles
from ..functions import text as T
from ..operators import embed, modules, search
from ..sources import tree
from .context import Context, gradle_text
from .index import Change, Index


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings, factory: Callable | None = None):
        self.spark, self.settings = spark, settings
        self.index = Index(spark, settings, factory)
        self.context = Context(spark, settings)

    # freshness

    def initialize(self) -> str:
        self.index.ensure_fresh()
        self.build_context()
        return f"Initialized: {self.index.platform()['type']}, {self.index.store.count('registry')} files indexed"

    def build_context(self) -> dict:
        parsed = self.index.store.read("parsed")
        if not self.settings.scope_context and (self.settings.exclude_prefixes or self.settings.include_prefixes):
            # the context covers the tree beyond the scope of the index
            parsed = tree.parse(tree.read_tree(self.spark, self.settings.repo_path, self.index.platform()["extensions"]))
        return self.context.build(parsed, self.index.modules(), self.index.platform())

    def ensure_index_fresh(self) -> Change:
        change = self.index.ensure_fresh(self.context.known_paths())
        if change.context_changed:
            self.build_context()
        return change

    # search

    def search(self, query: str, top_k: int | None = None, module_filter: str | None = None, literal: bool = False, filter_mode: str = "pre", form: str = "l2_squared") -> DataFrame:
        chunks = self.index.store.read("chunks")
        where = search.contains_filter(F.col("path_module"), module_filter, literal) if module_filter else None
        hits = search.knn(chunks, embed.embed_query(query, self.index.factory), top_k or self.settings.search_top_k, ["file_path", "chunk_index"], where=where, filter_mode=filter_mode, form=form)
        kept = search.collapse_results(hits.drop("vector"), self.settings.preferred_module_prefix)
        return kept.withColumn("relevance", roles.relevance(F.col("score"))).orderBy("score", "file_path", "chunk_index")

    def search_code(self, query: str, top_k: int | None = None, module_filter: str | None = None, response_format: str | None = None, **more) -> str:
        detailed = (response_format or self.settings.search_response_format) == "detailed"
        most = self.settings.search_snippet_lines_detailed if detailed else self.settings.search_snippet_lines_concise
        rows = self.search(query, top_k, module_filter, **more).withColumn("snippet", T.head(F.col("content"), most)).collect()
        return render_search(query, rows, detailed)

    # modules

    def get_architecture_context(self, include_exemplar: bool | None = None) -> str:
        wanted = self.settings.architecture_include_exemplar_default if include_exemplar is None else include_exemplar
        return self.context.render(wanted)

    def module_of(self, path: str) -> str | None:
        """The module of a file or directory; a fragment of a path stands for the first file that contains it."""
        registry = self.index.store.read("registry")
        p = F.col("file_path")
        path = path.strip("/")
        hit = registry.where((p == path) | p.startswith(path + "/")).agg(F.min("file_path").alias("f")).first().f
        inside = hit is not None and hit != path
        if hit is None:
            hit = registry.where(p.contains(path)).agg(F.min("file_path").alias("f")).first().f
        if hit is None:
            return None
        # of a directory the search starts at itself
        at = path + "/x" if inside else hit
        one = self.spark.createDataFrame([(at,)], "file_path string")
        return tree.nearest_module(one, self.index.modules()).first().build_module or None

    def get_module_info(self, path: str) -> str:
        module = self.module_of(path)
        if module is None:
            return f"Could not detect module for: {path}"
        files = self.index.store.module_files(module)
        named = files.withColumn("build_module", F.lit(module))
        packs = modules.packages(named).first()
        n, first = files.count(), [r.file_path for r in files.orderBy("file_path").limit(30).collect()]
        raw = gradle_text(self.spark, self.settings.repo_path, module)
        deps = self.spark.createDataFrame([(raw or "",)], "c string").select(tree.gradle_dependencies(F.col("c")).alias("d")).first().d
        out = [f"## Module: {module}", f"- **Path:** {module}", f"- **Files:** {n}"]
        if packs and packs.packages:
            out.append(f"- **Packages:** {', '.join(packs.packages)}")
        if deps:
            out += ["\n### Dependencies:", *(f"  - {d}" for d in deps[:20])]
        if first:
            out += [f"\n### Files ({n}):", *(f"  - {f}" for f in first)]
            if n > 30:
                out.append(f"  ... and {n - 30} more")
        return "\n".join(out)

    def find_feature_module(self, name: str) -> str:
        registry = self.index.store.read("registry")
        best = modules.feature_matches(registry.select("build_module").distinct(), name).limit(5)
        rows = best.join(modules.search_layers(registry), "build_module").orderBy(F.desc("score"), "build_module").collect()
        if not rows:
            known = [r.build_module for r in self.index.store.modules().limit(20).collect()]
            return f"No feature module found matching: '{name}'\n\nAvailable modules:\n" + "\n".join(f"  - {m}" for m in known)
        out = [f"## Feature modules matching '{name}':\n"]
        for r in rows:
            out += [f"### {r.build_module}", f"- Files: {r.files}"]
            out += [f"- Layers {word}: {', '.join(layers)}" for word, layers in (("present", r.present), ("missing", r.missing)) if layers]
            out.append("")
        return "\n".join(out)

    def expand_to_siblings(self, path: str) -> str:
        languages = self.index.platform()["languages"]
        language = "kotlin" if "kotlin" in languages and path.endswith(".kt") else "swift" if "swift" in languages and path.endswith(".swift") else None
        if language is None:
            return f"Cannot determine siblings for: {path}"
        targets = modules.sibling_targets(path, language)
        name = path.rsplit("/", 1)[-1]
        if targets is None:
            return f"Cannot determine architectural role of: {name}"
        listed = tree.read_tree(self.spark, self.settings.repo_path, names_only=True).select("file_path")
        rows = modules.siblings(listed, path, language).collect()
        suffix, base, _ = targets
        out = [f"## Siblings for: {name}", f"Base name: `{base}` | Role: `{suffix}`\n"]
        if any(r.found for r in rows):
            out += ["### Found:", *(f"  - **{r.role}**: {r.found}" for r in rows if r.found)]
        if any(not r.found for r in rows):
            out += ["\n### Not found (may need to be created):", *(f"  - **{r.role}**: {r.name}" for r in rows if not r.found)]
        return "\n".join(out)

    def get_project_overview(self) -> str:
        platform, store = self.index.platform(), self.index.store
        counted = modules.module_counts(store.read("registry")).orderBy("build_module").persist()
        out = ["## Project Overview\n", f"- **Platform:** {platform['type']}", f"- **Languages:** {', '.join(platform['languages'])}", f"- **Total indexed files:** {store.count('registry')}", f"- **Total chunks:** {store.count('chunks')}", f"- **Modules:** {counted.count()}"]
        for title, flag, most in (("Core/Shared", "is_core", None), ("Feature", "is_feature", None), ("Other", "is_other", 15)):
            part = counted.where(flag)
            n = part.count()
            if n:
                shown = part.collect() if most is None else part.limit(most).collect()
                out += [f"\n### {title} Modules ({n}):", *(f"  - `{r.build_module}` ({r.files} files)" for r in shown)]
                if n > len(shown):
                    out.append(f"  ... and {n - len(shown)} more")
        counted.unpersist()
        return "\n".join(out)

    def suggest_mandatory_addition(self, path: str, reason: str) -> str:
        exists = bool(tree.read_tree(self.spark, self.settings.repo_path, only=[path]).limit(1).count())
        return self.context.add(path, reason, exists)

    def remove_from_mandatory(self, path: str, reason: str) -> str:
        return self.context.remove(path, reason)

    def call(self, tool: str, **arguments) -> str:
        """A question by its tool name; errors become text."""
        tools = {
            "search_code": self.search_code, "get_architecture_context": self.get_architecture_context, "get_module_info": self.get_module_info, "find_feature_module": self.find_feature_module,
            "expand_to_siblings": self.expand_to_siblings, "get_project_overview": self.get_project_overview, "suggest_mandatory_addition": self.suggest_mandatory_addition,
        }
        if tool not in tools:
            return f"Unknown tool: {tool}"
        try:
            if self.settings.reindex_on_tool_call:
                self.ensure_index_fresh()
            return tools[tool](**arguments)
        except Exception as e:  # the caller reads text, whatever happens
            return f"Error: {e}"


def render_search(query: str, rows: list, detailed: bool) -> str:
    if not rows:
        return f"No results found for: '{query}'"
    out = [f"## Search Results for: '{query}'", f"Found {len(rows)} results:\n"]
    for k, r in enumerate(rows, 1):
        meta = [f"Relevance: {r.relevance}"]
        if r.path_module:
            meta.append(f"Module: `{r.path_module}`")
        if r.arch_role and r.arch_role != "other":
            meta.append(f"Role: `{r.arch_role}`")
        if r.declarations:
            meta.append(f"Declarations: {', '.join(r.declarations)}")
        out += [f"### {k}. {r.file_path}:{r.start_line}-{r.end_line}", " | ".join(meta)]
        if r.also_in:
            out.append(f"_Also declared in {len(r.also_in)} other module root(s): {', '.join(r.also_in)} (showing best match)_")
        out += [f"```\n{r.snippet}\n```", ""]
    if not detailed:
        out.append("_Concise view. Call with response_format='detailed' for larger snippets, or increase top_k for more results._")
    return "\n".join(out)
