import subprocess

import pytest

from srcatlas.config import Settings
from srcatlas.operators import embed
from srcatlas.plans.engine import Engine
from srcatlas.sources import git, tree


def engine(spark, root, **more):
    return Engine(spark, Settings(str(root), embedding_dim=32, mandatory_fan_in_threshold=0.1, **more), lambda: embed.hashed_ngrams(32))


def test_tree_scan(spark, kotlin_project):
    found = {r.file_path for r in tree.read_tree(spark, str(kotlin_project), [".kt", ".kts"]).collect()}
    assert {"_x/Kept.kt", ".y/AlsoKept.kt", "build.gradle.kts"} <= found
    assert not {p for p in found if p.startswith(("build/", "node_modules/"))}


def test_engine_end_to_end(spark, kotlin_project):
    e = engine(spark, kotlin_project)
    text = e.initialize()
    assert text.startswith("Initialized: android, ")
    n = e.index.store.count("registry")
    data = e.context.load()
    assert "core/src/main/kotlin/com/app/core/BaseViewModel.kt" in {b["file_path"] for b in data["base_files"]}
    assert data["exemplar_module"] == "features/favorites/presentation"
    assert "[MANDATORY] core/src/main/kotlin/com/app/core/BaseViewModel.kt" in e.get_architecture_context()
    assert "[EXEMPLAR]" in e.get_architecture_context(True)
    out = e.search_code("class F3ViewModel BaseViewModel", top_k=3, module_filter="features")
    assert out.startswith("## Search Results for:") and "Relevance:" in out
    assert e.search_code("x", module_filter="nothing'there%") == "No results found for: 'x'"
    info = e.get_module_info("features/favorites/presentation/src/main/kotlin/com/app/f0/F0Screen.kt")
    assert "## Module: features/favorites/presentation" in info and "implementation: :core" in info and "com.app.f0" in info
    assert e.get_module_info("no/such/path.kt") == "Could not detect module for: no/such/path.kt"
    assert "### features/favorites/presentation" in e.find_feature_module("favo_rites")
    assert "No feature module found matching: 'zzz'" in e.find_feature_module("zzz")
    assert "**Screen**: features/favorites/presentation/src/main/kotlin/com/app/f0/F0Screen.kt" in e.expand_to_siblings("features/favorites/presentation/src/main/kotlin/com/app/f0/F0ViewModel.kt")
    assert f"- **Total indexed files:** {n}" in e.get_project_overview()
    assert e.call("nonsense") == "Unknown tool: nonsense"
    assert e.call("search_code", bad=1).startswith("Error: ")

    assert e.suggest_mandatory_addition("no.kt", "r") == "File not found: no.kt"
    path = "features/favorites/presentation/src/main/kotlin/com/app/f0/F0Screen.kt"
    assert e.suggest_mandatory_addition(path, "r").startswith("Added") and e.suggest_mandatory_addition(path, "r").startswith("Already")
    e.build_context()
    assert path in e.context.known_paths()
    e.remove_from_mandatory("core/src/main/kotlin/com/app/core/BaseViewModel.kt", "r")
    e.build_context()
    assert "core/src/main/kotlin/com/app/core/BaseViewModel.kt" not in e.context.known_paths()


def sh(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True)


def test_incremental(spark, kotlin_project):
    root = kotlin_project
    (root / ".gitignore").write_text(".srcatlas/\n")
    sh(root, "init", "-q")
    sh(root, "add", "-A")
    sh(root, "commit", "-qm", "a")
    e = engine(spark, root)
    first = e.index.ensure_fresh()
    assert first.added > 10 and not first.updated
    version = e.index.store.manifest()["version"]
    assert not e.index.ensure_fresh().any and e.index.store.manifest()["version"] == version
    # a dirty edit is seen, and its revert as well
    p = root / "core/src/main/kotlin/com/app/core/Root.kt"
    before = p.read_text()
    p.write_text(before + "\nclass Added\n")
    assert e.index.ensure_fresh().updated == 1
    assert e.index.store.read("parsed").where("exists(declarations, d -> d.name = 'Added')").count() == 1
    p.write_text(before)
    assert e.index.ensure_fresh().updated == 1
    assert e.index.store.read("parsed").where("exists(declarations, d -> d.name = 'Added')").count() == 0
    # rename, removal and addition in a commit
    sh(root, "mv", "core/src/main/kotlin/com/app/core/Root.kt", "core/src/main/kotlin/com/app/core/Root2.kt")
    (root / "New's.kt").write_text("class New\n")
    (root / "_x/Kept.kt").unlink()
    sh(root, "add", "-A")
    sh(root, "commit", "-qm", "b")
    change = e.index.ensure_fresh(["core/src/main/kotlin/com/app/core/Root2.kt"])
    assert (change.added, change.updated, change.removed, change.context_changed) == (2, 0, 2, True)
    assert e.index.store.manifest()["commit"] == git.head(str(root))
    names = {r.file_path for r in e.index.store.read("registry").collect()}
    assert "New's.kt" in names and "_x/Kept.kt" not in names
    chunks = e.index.store.read("chunks")
    assert chunks.count() == chunks.select("file_path", "chunk_index").distinct().count()


def test_without_git(spark, kotlin_project):
    e = engine(spark, kotlin_project, exclude_module_prefixes="_x")
    e.index.ensure_fresh()
    assert e.index.store.read("registry").where("file_path like '_x/%'").count() == 0 or e.index.store.read("registry").where("startswith(file_path, '_x/')").count() == 0
    (kotlin_project / "Z.kt").write_text("class Z\n")
    assert e.index.ensure_fresh().added == 1


def test_stream(spark, kotlin_project, tmp_path_factory):
    from srcatlas.streaming import freshness

    e = engine(spark, kotlin_project)
    e.index.ensure_fresh()
    (kotlin_project / "S.kt").write_text("class S\n")
    box = tmp_path_factory.mktemp("notices")
    (box / "a.json").write_text('{"file_path":"S.kt","ts":"2024-01-01T00:00:00"}\n{"file_path":"S.kt","ts":"2024-01-01T00:00:00"}\n')
    q = freshness.keep_fresh(e.index, freshness.notices(spark, str(box)), str(tmp_path_factory.mktemp("ck")))
    q.awaitTermination(120)
    assert e.index.store.read("registry").where("file_path = 'S.kt'").count() == 1
    rates = freshness.change_rates(freshness.notices(spark, str(box)))
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").first().n == 2


@pytest.mark.parametrize("raw", ["", "{broken"])
def test_broken_documents(spark, tmp_path, raw):
    e = engine(spark, tmp_path)
    (tmp_path / ".srcatlas").mkdir()
    (tmp_path / ".srcatlas/mandatory.json").write_text(raw)
    assert e.context.load()["base_files"] == []
    assert e.index.store.read("chunks").count() == 0
