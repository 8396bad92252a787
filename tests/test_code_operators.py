"""Operators over code tables, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from srcatlas.config import Settings, prefix_list
from srcatlas.functions import paths, roles
from srcatlas.functions import text as T
from srcatlas.operators import chunking, delta, embed, intervals, modules, references, search, unions
from srcatlas.sources import tree


def files(spark, content):
    return spark.createDataFrame(sorted(content.items()), "file_path string, content string")


def generated(n, size):
    body = "".join(f"fun f{k}() {{\n" + "    x()\n" * (size - 2) + "}\n\n" for k in range(n))
    return "package com.example\n\nimport com.example.Other\n\n" + body


def index_of(spark, content):
    return references.SymbolIndex(references.file_models(tree.parse(files(spark, content))))


def test_prefix_list():
    assert prefix_list("legacy/, /old ,") == ["legacy", "old"]


def test_settings_from_environment():
    s = Settings.from_env(env={"SRCATLAS_REPO_PATH": "/x", "SRCATLAS_SEARCH_TOP_K": "7", "SRCATLAS_REINDEX_DIRTY": "false"})
    assert (s.repo_path, s.search_top_k, s.reindex_dirty, s.embedding_dim) == ("/x", 7, False, 768)


def test_scope(spark):
    df = spark.createDataFrame([("legacy/Foo.kt",), ("legacyish/Foo.kt",), ("legacy",), ("a\\b.kt",)], "p string")
    kept = lambda e, i: [r.p for r in df.where(paths.in_scope(F.col("p"), e, i)).collect()]
    assert kept(["legacy"], []) == ["legacyish/Foo.kt", "a\\b.kt"]
    assert kept([], ["a"]) == ["a\\b.kt"]
    assert kept(["legacy"], ["legacy"]) == []


def test_path_expressions(spark):
    df = spark.createDataFrame([("features/favorites/FavoritesViewModel.kt",), ("a/.kt",), ("x/..kt",), ("a.",), ("b/build.gradle.kts",)], "p string")
    rows = [tuple(r) for r in df.select(paths.extension(F.col("p")), paths.stem(F.col("p")), paths.path_module(F.col("p")), roles.arch_role(F.col("p"))).collect()]
    assert rows[0] == (".kt", "FavoritesViewModel", "features/favorites/FavoritesViewModel.kt", "viewmodel")
    import os

    assert [r[0] for r in rows] == [os.path.splitext(p)[1] for p in ("f.kt", ".kt", "..kt", "a.", "build.gradle.kts")]


def test_lines(spark):
    df = spark.createDataFrame([("",), ("a\nb\n",), ("a\r\nb",), ("\n",)], "t string")
    assert [list(r[0]) for r in df.select(T.lines(F.col("t"))).collect()] == [[], ["a", "b"], ["a", "b"], [""]]
    assert [r[0] for r in df.select(T.line_count(F.col("t"))).collect()] == [1, 3, 2, 2]


@pytest.mark.parametrize(
    "n,size,spans,overlap",
    [(5, 8, [(1, 54)], None), (15, 12, [(5, 120), (122, 198)], False), (40, 10, None, True)],
)
def test_chunks(spark, n, size, spans, overlap):
    rows = chunking.chunk_files(tree.parse(files(spark, {"a/b/C.kt": generated(n, size)}))).orderBy("chunk_index").collect()
    if n == 40:
        assert len(rows) == 5 and rows[0].start_line == 5 and [r.has_overlap for r in rows] == [False] + [True] * 4
        assert all(b.start_line == a.end_line + 2 - 20 for a, b in zip(rows, rows[1:]))
    elif n == 5:
        assert [r.chunk_type for r in rows] == ["whole_file"] and rows[0].declarations == [f"f{k}" for k in range(5)]
    else:
        assert len(rows) == 2 and not any(r.has_overlap for r in rows) and all(r.chunk_type == "ast_chunk" for r in rows)
        assert rows[0].start_line == 5 and rows[1].content.startswith("package com.example\n\nimport com.example.Other\n")
        assert all(r.end_line - r.start_line + 1 <= 125 for r in rows)


def test_chunk_of_empty_file(spark):
    (row,) = chunking.chunk_files(tree.parse(files(spark, {"E.kt": ""}))).collect()
    assert (row.start_line, row.end_line, row.total_chunks, row.chunk_type) == (1, 0, 1, "whole_file")


def contract_graph():
    core = "package com.app.core\n\n"
    out = {
        "core/UIState.kt": core + "interface UIState\n", "core/UIAction.kt": core + "interface UIAction\n", "core/ViewEffect.kt": core + "interface ViewEffect\n",
        "core/FlowViewModel.kt": core + "abstract class FlowViewModel {\n    fun f() {}\n}\n",
        "core/StateViewModel.kt": core + "import com.app.core.UIState\nimport com.app.core.UIAction\nimport com.app.core.FlowViewModel\n\nabstract class StateViewModel<S : UIState> : FlowViewModel() {\n    fun g() {}\n}\n",
        "ext/UseCaseExt.kt": "package com.app.ext\n\nfun String.useCase() {}\n", "ext/RepositoryExt.kt": "package com.app.ext\n\nfun String.repository() {}\n",
        "other/AuthService.kt": "package com.app.other\n\n@Singleton\nclass AuthService {\n    fun a() {}\n}\n",
    }
    for k in range(12):
        p = f"package com.app.f{k}\n\n"
        out[f"f{k}/F{k}State.kt"] = p + f"import com.app.core.UIState\n\ndata class F{k}State(val a: Int) : UIState\n"
        out[f"f{k}/F{k}Action.kt"] = p + f"import com.app.core.UIAction\n\nsealed class F{k}Action : UIAction\n"
        out[f"f{k}/F{k}ViewModel.kt"] = p + f"import com.app.core.StateViewModel\nimport com.app.ext.useCase\nimport com.app.ext.repository\n\nclass F{k}ViewModel : StateViewModel<F{k}State>() {{\n    fun x() {{}}\n}}\n"
    return out


def test_contract_graph(spark):
    index = index_of(spark, contract_graph())
    rows = references.fan_in(index).collect()
    found = {r.file_path: (r.fan_in_count, round(r.confidence, 6)) for r in rows}
    assert found == {"core/UIState.kt": (13, 1.0), "core/UIAction.kt": (13, 1.0), "core/StateViewModel.kt": (12, 1.0), "ext/UseCaseExt.kt": (12, 1.0), "ext/RepositoryExt.kt": (12, 1.0), "core/FlowViewModel.kt": (1, 0.527273)}
    assert [r.file_path.split("/")[0] for r in rows][:4] == ["core"] * 4  # priority directories first
    role = {r.file_path: r.role for r in index.files.collect()}
    assert role["core/UIState.kt"] == "marker_interface" and role["core/StateViewModel.kt"] == "base_viewmodel"
    assert role["ext/UseCaseExt.kt"] == "extension_container" and role["other/AuthService.kt"] == "service" and role["f0/F0Action.kt"] == "ui_contract"

    seeds = spark.createDataFrame([("f0/F0State.kt",), ("f0/F0Action.kt",), ("f0/F0ViewModel.kt",)], "file_path string")
    deps = references.exemplar_dependencies(index, seeds).collect()
    assert {r.file_path for r in deps if r.level == 0} == {"core/StateViewModel.kt", "ext/UseCaseExt.kt", "ext/RepositoryExt.kt", "core/UIState.kt", "core/UIAction.kt"}
    assert {r.file_path for r in deps if r.level == 1} == {"core/FlowViewModel.kt", "core/ViewEffect.kt"}
    assert references.exemplar_dependencies(index, seeds, max_results=3).count() == 3
    above = references.supertype_closure(index, spark.createDataFrame([("core/StateViewModel.kt",)], "file_path string")).collect()
    assert [r.file_path for r in above] == ["core/FlowViewModel.kt"]
    assert references.supertype_closure(index, seeds, depth=0).count() == 0


def test_small_graph(spark):
    content = {"base/BaseViewModel.kt": "package b\n\nabstract class BaseViewModel {\n    fun f() {}\n}\n", "base/BaseUseCase.kt": "package b\n\nabstract class BaseUseCase {\n    fun f() {}\n}\n"}
    content |= {f"f{k}/F{k}.kt": f"package f{k}\n\nimport b.BaseViewModel\n\nclass F{k} : BaseViewModel()\n" for k in range(10)}
    (row,) = references.fan_in(index_of(spark, content)).collect()
    assert (row.file_path, row.fan_in_count, round(row.fan_in_ratio, 6)) == ("base/BaseViewModel.kt", 10, 0.833333)


def test_no_files(spark):
    assert references.fan_in(index_of(spark, {"x.txt": "a"})).count() == 0


def test_swift_models(spark):
    index = index_of(spark, {"A.swift": "import UIKit\nclass A: B, C {\n  func f() {}\n}\n", "B.swift": "class B {}\n"})
    a = {r.file_path: r for r in index.files.collect()}["A.swift"]
    assert (sorted(a.symbols), a.supertypes, [i.path for i in a.imports], a.role) == (["A", "f"], ["B", "C"], ["UIKit"], None)
    above = references.supertype_closure(index, spark.createDataFrame([("A.swift",)], "file_path string"))
    assert [r.file_path for r in above.collect()] == ["B.swift"]


def hits(spark, rows):
    return spark.createDataFrame(rows, "file_path string, path_module string, chunk_index int, declarations array<string>, score double")


def test_collapse(spark):
    two = hits(spark, [("appA/x/F.kt", "appA/x", 0, ["Foo"], 0.9), ("appB/x/F.kt", "appB/x", 0, ["Foo"], 0.3)])
    (row,) = search.collapse_results(two).collect()
    assert (row.file_path, row.also_in) == ("appB/x/F.kt", ["appA"])
    (row,) = search.collapse_results(two, "appA").collect()
    assert row.file_path == "appA/x/F.kt"
    same = hits(spark, [("appA/F.kt", "appA", 0, ["Foo"], 0.9), ("appA/F.kt", "appA", 1, ["Foo"], 0.3), ("b/Bar.kt", "", 0, [], 0.1)])
    assert search.collapse_results(same).where("also_in is null").count() == 3


def test_relevance(spark):
    assert [r[0] for r in spark.createDataFrame([(0.3,), (0.8,), (1.5,)], "s double").select(roles.relevance(F.col("s"))).collect()] == ["high", "medium", "low"]


def test_knn(spark):
    items = spark.createDataFrame([(k, f"feat_{k}" if k % 2 else f"featX{k}", [float(k), 0.0]) for k in range(10)], "id int, m string, v array<float>")
    assert [(r.id, r.score) for r in search.knn(items, [0.0, 0.0], 3, ["id"], "v").collect()] == [(0, 0.0), (1, 1.0), (2, 4.0)]
    assert [r.score for r in search.knn(items, [0.0, 0.0], 3, ["id"], "v", form="l2").collect()] == [0.0, 1.0, 2.0]
    wild, literal = search.contains_filter(F.col("m"), "feat_"), search.contains_filter(F.col("m"), "feat_", literal=True)
    assert search.knn(items, [0.0, 0.0], 9, ["id"], "v", wild).count() == 9
    assert [r.id for r in search.knn(items, [0.0, 0.0], 2, ["id"], "v", literal).collect()] == [1, 3]
    assert [r.id for r in search.knn(items, [0.0, 0.0], 2, ["id"], "v", literal, filter_mode="post").collect()] == [1]
    queries = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 0.0])], "query_id int, query_vector array<float>")
    best = {(r.query_id, r["rank"]): r.id for r in search.knn_batch(items, queries, 2, ["id"], "v").collect()}
    assert best == {(0, 1): 0, (0, 2): 1, (1, 1): 9, (1, 2): 8}
    for block in (1, 2):  # queries in blocks
        again = {(r.query_id, r["rank"]): r.id for r in search.knn_batch(items, queries, 2, ["id"], "v", block=block).collect()}
        assert again == best
    tied = spark.createDataFrame([(k, [1.0, 0.0]) for k in (5, 3, 4)] + [(6, None)], "id int, v array<float>")
    assert [r.id for r in search.knn_batch(tied, queries.limit(1), 2, ["id"], "v").orderBy("rank").collect()] == [3, 4]


def test_base_files(spark):
    cols = "file_path string, fan_in_count long, confidence double, source string, role string, rank int"
    found = spark.createDataFrame([("appA/Base.kt", 5, 1.0, "fan_in", None, 1), ("appB/Base.kt", 9, 1.0, "fan_in", None, 2), ("x/Gone.kt", 3, 1.0, "fan_in", None, 3)], cols)
    models = spark.createDataFrame([("appA/Base.kt", ["Base"], ["Base"]), ("appB/Base.kt", ["Base"], ["Base"])], "file_path string, symbols array<string>, type_symbols array<string>")
    names = lambda rows: spark.createDataFrame([(p, k) for k, p in enumerate(rows)], "file_path string, rank int")
    kept = unions.base_files([found], models, names(["x/Gone.kt"]), names(["user/U.kt"]), names(["appB/Base.kt"])).collect()
    assert [(r.file_path, r.source, r.confirmed) for r in kept] == [("appB/Base.kt", "fan_in", True), ("user/U.kt", "user", True)]
    kept = unions.base_files([found], models, names([]), names([]), names([]), "appA").collect()
    assert [r.file_path for r in kept] == ["appA/Base.kt", "x/Gone.kt"]


def test_exemplar(spark):
    rows = [(f"a/{n}.kt", 3) for n in ("XViewModel", "XScreen", "XState")] + [(f"b/{n}.kt", 3) for n in ("YViewModel", "YScreen", "YState", "Helper")] + [("c/Z.kt", 1)]
    sized = spark.createDataFrame(rows, "file_path string, line_count int")
    mods = spark.createDataFrame([("a",), ("b",), ("c",), ("gone",)], "path string")
    scored = modules.score_modules(sized, mods, "kotlin").persist()
    best = modules.best_exemplar(scored).first()
    assert (best.module_path, best.score, best.total_files, best.total_lines) == ("b", 0.5, 4, 12)
    assert best.missing == ["usecase", "repository", "service"]
    assert modules.best_exemplar(scored, "/c/").first().module_path == "c"
    assert modules.best_exemplar(scored, "gone").first().module_path == "b"
    chosen = modules.exemplar_files(modules.best_exemplar(scored), list(roles.KOTLIN_LAYERS)).collect()
    assert [r.file_path for r in chosen] == ["b/YViewModel.kt", "b/YScreen.kt", "b/YState.kt"]


def test_scored_modules_hold_no_file_lists(spark):
    """A module's row has the first file of a layer, however many there are; files beside the root count for ''."""
    rows = [(f"a/x{k % 3}/F{k}ViewModel.kt", 2) for k in range(50)] + [("TopState.kt", None)]
    sized = spark.createDataFrame(rows, "file_path string, line_count int")
    scored = modules.score_modules(sized, spark.createDataFrame([("a",), ("a/x1",), ("",)], "path string"), "kotlin")
    assert not [f.name for f in scored.schema if f.dataType.typeName() == "array" and f.name not in ("present", "missing")]
    found = {r.module_path: (r.total_files, r.total_lines, r.first_viewmodel, r.first_state) for r in scored.collect()}
    assert found == {"a": (50, 100, "a/x0/F0ViewModel.kt", None), "a/x1": (17, 34, "a/x1/F10ViewModel.kt", None), "": (51, 100, "a/x0/F0ViewModel.kt", "TopState.kt")}


def test_platform(spark):
    kind = lambda rows: tree.platform(spark.createDataFrame(rows, "path string, is_dir boolean")).first().type
    assert kind([("build.gradle.kts", False)]) == "android"
    assert kind([("MyApp.xcodeproj", True)]) == "ios"
    assert kind([("README.md", False)]) == "unknown"
    assert kind([("a/build.gradle", False), ("Package.swift", False)]) == "multi"


def test_modules_and_gradle(spark):
    entries = spark.createDataFrame([("build.gradle.kts", False), ("features/x/build.gradle", False), ("features/x/build.gradle.kts", False)], "path string, is_dir boolean")
    mods = tree.build_modules(entries)
    assert sorted((r.name, r.path, r.build_file, r.is_feature) for r in mods.collect()) == [("root", "", "build.gradle.kts", False), ("x", "features/x", "build.gradle", True), ("x", "features/x", "build.gradle.kts", True)]
    placed = tree.nearest_module(spark.createDataFrame([("features/x/a/b/C.kt",), ("D.kt",)], "file_path string"), mods)
    assert {r.file_path: r.build_module for r in placed.collect()} == {"features/x/a/b/C.kt": "features/x", "D.kt": ""}
    text = "implementation(project(\":core\"))\napi 'a:b:1'\ntestImplementation \"no\"\n"
    assert spark.createDataFrame([(text,)], "c string").select(tree.gradle_dependencies(F.col("c"))).first()[0] == ["implementation: :core", "api: a:b:1"]


def test_siblings_and_reports(spark):
    listed = spark.createDataFrame([("f/p/AViewModel.kt",), ("f/p/AScreen.kt",), ("f/domain/AUseCase.kt",), ("z/AGraph.kt",)], "file_path string")
    rows = modules.siblings(listed, "f/p/AViewModel.kt", "kotlin").collect()
    assert [(r.role, r.found) for r in rows] == [("Screen", "f/p/AScreen.kt"), ("ScreenState", None), ("ScreenAction", None), ("UseCase", "f/domain/AUseCase.kt"), ("Graph", None)]
    assert modules.sibling_targets("f/Plain.kt", "kotlin") is None and modules.sibling_targets("f/ViewModel.kt", "kotlin") is None
    reg = spark.createDataFrame([("features/a_b", "features/a_b/src/main/java/x/y/AViewModel.kt"), ("features/a_b", "features/a_b/QFragment.kt"), ("core", "core/C.kt")], "build_module string, file_path string")
    match = modules.feature_matches(reg.select("build_module").distinct(), "A-B").collect()
    assert [(r.build_module, round(r.score, 6)) for r in match] == [("features/a_b", 0.2)]
    layers = {r.build_module: (r.files, r.present, r.missing) for r in modules.search_layers(reg).collect()}
    assert layers["features/a_b"] == (2, ["ViewModel", "Screen"], ["UseCase", "Repository", "Service"])
    assert {r.build_module: r.packages for r in modules.packages(reg).collect()} == {"features/a_b": ["x.y"], "core": []}
    counts = {r.build_module: (r.files, r.is_core, r.is_feature, r.is_other) for r in modules.module_counts(reg).collect()}
    assert counts == {"features/a_b": (2, False, True, False), "core": (1, True, False, False)}
    assert [r.file_path for r in modules.gap_hint(reg, spark.createDataFrame([("core/X.kt",)], "file_path string")).collect()] == ["core/C.kt"]


def long_kotlin(n):
    return "".join(f"fun f{k}() {{\n" + '    val s = "}" // {\n' * 8 + "}\n\n" for k in range(n))


def test_extract(spark):
    content = {"Short.kt": "fun a() {}\n", "Long.kt": long_kotlin(30), "None.kt": "x = 1\n" * 300, "Big.kt": "class Big {\n" + "    val a = 1\n" * 300 + "}\n", "L.txt": "y" * 90 + "\n" + "z\n" * 9000}
    got = {r.file_path: r.extract for r in intervals.extract(files(spark, content)).collect()}
    assert got["Short.kt"] == content["Short.kt"]
    lines = got["Long.kt"].split("\n")
    # ten methods of ten lines fit in a hundred; one blank line between them is within the merge
    assert lines[0] == "fun f0() {" and len(lines) == 109 and "fun f9() {" in lines and "fun f10() {" not in lines
    assert len(got["None.kt"].split("\n")) == 100
    assert len(got["Big.kt"].split("\n")) == 40
    assert len(got["L.txt"]) == 8000


def test_extract_marks_gaps(spark):
    body = "".join(f"fun f{k}() {{\n    x()\n}}\n" + "y = 1\n" * 40 for k in range(8))
    (row,) = intervals.extract(files(spark, {"G.kt": body})).collect()
    assert row.extract.split("\n// ... (truncated)\n\n")[1] == "fun f1() {\n    x()\n}"


def test_intervals_and_budget(spark):
    df = spark.createDataFrame([(1, [(0, 2), (4, 5), (8, 9)]), (2, [(0, 9), (1, 2), (11, 12)]), (3, [])], "k int, r array<struct<s:int,e:int>>")
    found = {r.k: [tuple(x) for x in r.m] for r in df.select("k", intervals.join_near(F.col("r")).alias("m")).collect()}
    assert found == {1: [(0, 5), (8, 9)], 2: [(0, 12)], 3: []}
    rows = spark.createDataFrame([([(1, 60), (1, 50), (1, 1)],)], "r array<struct<s:int,e:int>>")
    assert [tuple(x) for x in rows.select(intervals.within_budget(F.col("r"), 100).alias("b")).first().b] == [(1, 60)]


def test_block_ends():
    lines = ["fun a() {", "  val s = \"} { ${f { 1 }}\"", "  val c = '{'  // }", "  /* } */", "  if (x) { y() }", "}", "fun b() = 1", "fun c() {", "  open"]
    assert intervals.block_ends(lines, [0, 6, 7]) == [5, 8, 8]  # no block closes below: to the end of a short file
    assert intervals.block_ends(["fun a() {", "}"] + ["x"] * 60, [0, 2]) == [1, 42]
    assert intervals.block_ends(["func a() {", '  let s = "\\(f { $0 }) }"', "}"], [0], "\\(") == [2]


def test_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "file_path string, content_hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "0"), ("w", "4")], "file_path string, content_hash string")
    ops = delta.diff(a, b)
    assert {r.file_path: r.op for r in ops.collect()} == {"x": "keep", "y": "update", "z": "add", "w": "remove"}


def test_embedding(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("hello world",)], "t string")
    v = [r[0] for r in df.select(embed.embedding(F.col("t"), lambda: embed.hashed_ngrams(16), batch=2)).collect()]
    assert v[0] == v[3] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and set(v[1]) == set(v[2]) == {0.0}
    assert len(embed.embed_query("find it", lambda: embed.hashed_ngrams(16))) == 16


def test_package_references_without_pairs(spark):
    """Counts, firsts and orders taken per package are those of all pairs, with files that are alone, that import themselves
    or that import a file both by name and by wildcard."""
    rows, role = [], "service"
    for k in range(24):
        package = f"p{k % 3}" if k < 22 else f"alone{k}"
        imports = [(f"p{(k + 1) % 3}", True)] * (k % 3 + (k == 5)) + [("p0.S0", False), (f"p{(k * 5) % 22 % 3}.S{(k * 5) % 22}", False)] + ([("p0", True)] if k % 4 == 0 else [])
        rows.append((f"f{k:02}.kt", package, [f"S{k}"], [f"S{k}"], ["S1"] if k % 2 else [], imports, role if k % 7 else None))
    files = spark.createDataFrame(rows, "file_path string, package string, symbols array<string>, type_symbols array<string>, supertypes array<string>, imports array<struct<path:string,is_wildcard:boolean>>, role string")
    index = references.SymbolIndex(files)
    listed = lambda df: sorted(map(tuple, df.collect()))
    edges = references.import_targets(index, files)
    assert listed(references.import_counts(index, files).select("source", "target", "n")) == listed(edges.groupBy("source", "target").count())
    assert listed(references.import_fan_in(index, files)) == listed(references.count_fan_in(edges))
    pairs = references.sibling_targets(index, files)
    assert listed(references.sibling_counts(index, files)) == listed(pairs.groupBy("source").agg(F.count("*"), F.min("target")))
    frontier = spark.createDataFrame([(f"f{k:02}.kt", k + 1) for k in (4, 5, 8, 9, 13, 22)], "node string, ordinal int")
    models = files.join(frontier.withColumnRenamed("node", "file_path"), "file_path")
    every = edges.unionByName(references.supertype_targets(index, files)).unionByName(pairs).join(frontier.withColumnRenamed("node", "source"), "source").join(frontier.select(F.col("node").alias("target")), "target", "left_anti")
    reached = references.first_reached(index, models).join(frontier.select(F.col("node").alias("target")), "target", "left_anti")
    assert listed(reached.groupBy("target").agg(F.min("source_order"))) == listed(every.groupBy("target").agg(F.min("ordinal")))


def test_import_pairs_send_few_copies(spark, monkeypatch):
    """Each file is sent once for every block that it meets: blocks grow with the pairs up to a bound, and results stay whole."""
    monkeypatch.setattr(references, "_BLOCK", 2)
    monkeypatch.setattr(references, "_MOST", 8, raising=False)
    sent, frame = [], type(spark.range(0))
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: (sent.append(self) if by == ("package", "a", "b") else None, real(self, n, *by))[1])
    kinds = "array(named_struct('path', 'p', 'is_wildcard', true), named_struct('path', concat('p.T', id % 5), 'is_wildcard', false))"
    sources = spark.range(64).selectExpr("concat('s', id) as file_path", "'q' as package", f"{kinds} as imports", "'service' as role", "array(concat('S', id)) as symbols")
    targets = spark.range(64).selectExpr("concat('t', id) as file_path", "'p' as package", "cast(array() as array<struct<path: string, is_wildcard: boolean>>) as imports", "'service' as role", "array(concat('T', id)) as symbols")
    files = sources.unionByName(targets)
    index = references.SymbolIndex(files)
    listed = lambda df: sorted(map(tuple, df.collect()))
    found = listed(references.import_counts(index, files).select("source", "target", "n"))
    assert found == listed(references.import_targets(index, files).groupBy("source", "target").count())
    assert len(found) == 64 * 64 and sum(r[2] for r in found) == 64 * 65
    assert sent[0].selectExpr("sum(size(sources) + size(targets))").first()[0] <= 64 * 64 * 2 / 4
