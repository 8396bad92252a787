"""The architecture context: base files, exemplar, and what the user added or removed."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import roles
from ..operators import intervals, modules, references, unions
from ..sources import tree
from ..sources.scratch import cut
from ..sources.store import Files

EMPTY = {"base_files": [], "exemplar_module": None, "exemplar_files": [], "user_additions": [], "user_removals": [], "last_updated": None}
BASE = "file_path string, source string, role string, fan_in long, confidence double, confirmed boolean, part int, rank int"


class Context:
    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self.files = Files(spark, str(settings.data_path))
        self._cached: tuple[str, str] | None = None

    def load(self) -> dict:
        raw = self.files.read("mandatory.json")
        try:
            found = json.loads(raw) if raw else {}
        except ValueError:
            found = {}
        return {k: found.get(k, v if not isinstance(v, list) else list(v)) for k, v in EMPTY.items()}

    def save(self, data: dict) -> None:
        data["last_updated"] = datetime.now().isoformat()
        self.files.replace("mandatory.json", json.dumps(data, indent=2))
        self._cached = None

    def _paths(self, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([(r["file_path"], k) for k, r in enumerate(rows)], "file_path string, rank int")

    def build(self, parsed: DataFrame, build_modules: DataFrame, platform: dict) -> dict:
        """Fan-in, exemplar, its dependencies and supertypes, and the user's choices, as one document."""
        s, had = self.settings, self.load()
        index = references.SymbolIndex(cut(references.file_models(parsed), "models"))
        fan_in = cut(references.fan_in(index, s.mandatory_max_base_files, s.mandatory_fan_in_threshold, s.mandatory_contract_min_ratio))
        language = next(iter(platform["languages"]), None)
        exemplar, chosen = None, []
        if language:
            sized = parsed.select("file_path", "line_count")
            features = build_modules.where("is_feature")
            if not features.limit(1).count():
                features = modules.feature_directories(sized)
            candidates = features.select("path")
            if s.exemplar_module.strip("/"):
                candidates = candidates.unionByName(self.spark.createDataFrame([(s.exemplar_module.strip("/"),)], "path string"))
            best = cut(modules.best_exemplar(modules.score_modules(sized, candidates, language), s.exemplar_module))
            found = best.first()
            if found is not None:
                exemplar = found.module_path
                layers = list(roles.KOTLIN_LAYERS if language == "kotlin" else roles.SWIFT_LAYERS)
                chosen = [r.file_path for r in modules.exemplar_files(best, layers).collect()]
        parts = [fan_in]
        if chosen and s.mandatory_include_exemplar_deps:
            seeds = self.spark.createDataFrame([(p,) for p in chosen], "file_path string")
            parts.append(cut(references.exemplar_dependencies(index, seeds, max_results=s.mandatory_max_contract_files).drop("level")))
        seeds = parts[0].select("file_path")
        for p in parts[1:]:
            seeds = seeds.unionByName(p.select("file_path"))
        parts.append(cut(references.supertype_closure(index, seeds.distinct(), s.mandatory_supertype_depth, s.mandatory_max_contract_files).drop("level")))
        base = unions.base_files(
            parts, index.files, self._paths(had["user_removals"]), self._paths(had["user_additions"]), self._paths([b for b in had["base_files"] if b.get("confirmed")]), s.preferred_module_prefix,
        )
        names = ["file_path", "source", "role", "fan_in", "confidence", "confirmed"]
        data = had | {"base_files": [r.asDict() for r in base.select(*names).collect()], "exemplar_module": exemplar, "exemplar_files": chosen}
        self.save(data)
        return data

    def sections(self, with_exemplar: bool = False) -> DataFrame:
        """(ordinal, kind, file_path, extract) of the context's files that exist."""
        data, s = self.load(), self.settings
        rows = [("MANDATORY", b["file_path"]) for b in data["base_files"]] + [("EXEMPLAR", p) for p in (data["exemplar_files"] if with_exemplar else [])]
        wanted = self.spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "ordinal int, kind string, file_path string")
        files = tree.read_tree(self.spark, s.repo_path, only=[p for _, p in rows]).select("file_path", "content")
        cut = intervals.extract(files, s.mandatory_max_method_lines, s.mandatory_max_lines_per_file)
        return wanted.join(cut.select("file_path", "extract"), "file_path").orderBy("ordinal")

    def render(self, with_exemplar: bool = False) -> str:
        data = self.load()
        key = f"{data['last_updated']}"
        if with_exemplar and self._cached and self._cached[0] == key:
            return self._cached[1]
        rows = self.sections(with_exemplar).collect()
        text = "\n\n".join(f"=== [{r.kind}] {r.file_path} ===\n{r.extract}" for r in rows)
        if rows:
            text += "\n\nNOTE: suggest files that are missing here; files that do not belong can be removed."
        if with_exemplar:
            self._cached = (key, text)
        return text

    def add(self, file_path: str, reason: str, exists: bool) -> str:
        data = self.load()
        if any(b["file_path"] == file_path for b in data["base_files"]):
            return f"Already in the context: {file_path}"
        if not exists:
            return f"File not found: {file_path}"
        now = datetime.now().isoformat()
        data["user_additions"] = [a for a in data["user_additions"] if a["file_path"] != file_path] + [{"file_path": file_path, "reason": reason, "date": now}]
        data["user_removals"] = [r for r in data["user_removals"] if r["file_path"] != file_path]
        data["base_files"].append({"file_path": file_path, "source": "user", "role": None, "fan_in": 0, "confidence": 1.0, "confirmed": True})
        self.save(data)
        return f"Added to the context: {file_path}"

    def remove(self, file_path: str, reason: str) -> str:
        data = self.load()
        data["base_files"] = [b for b in data["base_files"] if b["file_path"] != file_path]
        data["user_additions"] = [a for a in data["user_additions"] if a["file_path"] != file_path]
        data["user_removals"].append({"file_path": file_path, "reason": reason, "date": datetime.now().isoformat()})
        self.save(data)
        return f"Removed from the context: {file_path}"

    def hint(self, registry: DataFrame) -> list[str]:
        return [r.file_path for r in modules.gap_hint(registry.select("file_path"), self._paths(self.load()["base_files"])).collect()]

    def known_paths(self) -> list[str]:
        return [b["file_path"] for b in self.load()["base_files"]]


def gradle_text(spark: SparkSession, root: str, module: str) -> str | None:
    """The module's build file, the Kotlin one first."""
    base = module + "/" if module else ""
    found = {r.file_path: r.content for r in tree.read_tree(spark, root, only=[base + "build.gradle.kts", base + "build.gradle"]).select("file_path", F.col("content")).collect()}
    return found.get(base + "build.gradle.kts", found.get(base + "build.gradle"))
