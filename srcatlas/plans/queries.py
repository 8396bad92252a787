"""Operators of the engine over the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, roles, text, vectors
from ..operators import chunking, delta, embed, intervals, modules, references, search, unions
from ..sources import tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DISTANCE = "round(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))), 6)"
_QUERY_VECTOR = "with q as (select embedding as e from embeddings order by vec_id limit 1), d as (select vec_id, label, " + _DISTANCE.format(a="embedding", b="e") + " as score from embeddings, q) "


def _first_vector(items: DataFrame) -> list[float]:
    return items.orderBy("vec_id").limit(1).first().embedding


def _hits(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(_QUERY_VECTOR + "select vec_id, label, score, case when score <= 0.6 then 'high' when score <= 1.0 then 'medium' else 'low' end as relevance from d order by score, vec_id limit 5")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return _hits(search.knn(items, _first_vector(items), 5, ["vec_id"], "embedding")).withColumn("relevance", roles.relevance(F.col("score")))


@query(_QUERY_VECTOR + "select vec_id, label, score from d where label::varchar like '%1%' order by score, vec_id limit 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    where = search.contains_filter(F.col("label").cast("string"), "1")
    return _hits(search.knn(items, _first_vector(items), 10, ["vec_id"], "embedding", where))


@query(_QUERY_VECTOR + "select * from (select vec_id, label, score from d order by score, vec_id limit 50) where label::varchar like '%1%'")
def knn_post_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    where = search.contains_filter(F.col("label").cast("string"), "1")
    return _hits(search.knn(items, _first_vector(items), 50, ["vec_id"], "embedding", where, filter_mode="post"))


@query(
    "select label, count(*) as n, count(distinct vec_id) as ids, round(max(abs(list_sum(list_transform(embedding, lambda x: x::double * x::double)) - 1.0)), 5) as off from embeddings group by label"
)
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("u", embed.unit(F.col("embedding")))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.round(F.max(F.abs(vectors.dot(F.col("u"), F.col("u")) - 1.0)), 5).alias("off"))


@query(
    """with g as (select p_name, list_sort(list_distinct(list(p_brand))) as roots, min((p_retailprice, p_partkey)) as best from part group by p_name)
    select p_partkey, p.p_name as name, p_brand as brand, case when len(roots) >= 2 then array_to_string(list_filter(roots, lambda r: r <> p_brand), ',') end as also_in
    from part p join g on p.p_name = g.p_name where len(roots) < 2 or (p_retailprice, p_partkey) = best"""
)
def parallel_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    kept = search.collapse_parallel(parts, F.col("p_name"), F.col("p_brand"), [F.col("p_retailprice")], [F.col("p_partkey")])
    return kept.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.array_join("also_in", ",").alias("also_in"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("source"), F.explode(href).alias("target"))


_LINKS = "with e as (select distinct page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages), n as (select count(*) as n from pages) "


@query(_LINKS + "select target, count(*) as fan_in_count, round(count(*) / any_value(n), 6) as fan_in_ratio, round(least(count(*) / any_value(n) * 10, 1.0), 6) as confidence from e, n group by target having count(*) / any_value(n) >= 0.02")
def fan_in_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _links(spark, sf_dir).select(F.col("source").cast("string").alias("source"), "target")
    total = table(spark, sf_dir, "pages").agg(F.count("*").alias("_total"))
    ranked = references.rank_fan_in(references.count_fan_in(edges).crossJoin(F.broadcast(total)), F.col("_total"), F.lit(None).cast("string"), F.col("target"))
    return ranked.select("target", "fan_in_count", F.round("fan_in_ratio", 6).alias("fan_in_ratio"), F.round("confidence", 6).alias("confidence"))


@query(
    """with r as (select o_orderkey as source, o_orderpriority || '.' || o_custkey as path from orders),
    f as (select c_mktsegment, c_custkey, case when c_mktsegment = 'BUILDING' then '1-URGENT' else '2-HIGH' end || '.' || c_custkey as fqn from customer where c_mktsegment in ('BUILDING', 'MACHINERY')),
    hit as (select source, c_custkey as target from r join f on path = fqn), miss as (select source, split_part(path, '.', 2) as symbol from r where path not in (select fqn from f)),
    a as (select * from hit union all select source, c_custkey from miss join customer on symbol = c_custkey::varchar)
    select target, count(*) as n, min(source) as first_source from a group by target"""
)
def priority_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").otherwise("2-HIGH")
    exact = customers.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.concat_ws(".", segment, F.col("c_custkey").cast("string")).alias("fqn"), F.col("c_custkey").alias("target"))
    fallback = customers.select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_custkey").alias("target"))
    refs = orders.select(F.col("o_orderkey").alias("source"), F.concat_ws(".", "o_orderpriority", F.col("o_custkey").cast("string")).alias("path"))
    return references.resolve(refs, exact, fallback).groupBy("target").agg(F.count("*").alias("n"), F.min("source").alias("first_source"))


_EDGES = "e as (select distinct o_custkey as s, o_orderkey % (select count(*) from customer) as t from orders), seed as (select c_custkey as node from customer where c_nationkey = 0)"


@query(
    f"""with {_EDGES}, l0 as (select distinct t as node from e join seed on s = node where t not in (select node from seed)),
    l1 as (select distinct t as node from e join l0 on s = node where t not in (select node from seed) and t not in (select node from l0))
    select node, 0 as level from l0 union all select node, 1 from l1"""
)
def closure_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = customers.count()
    edges = orders.select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % n).alias("target")).distinct()
    seeds = customers.where("c_nationkey = 0").select(F.col("c_custkey").alias("node"))

    def expand(frontier: DataFrame, level: int) -> DataFrame:
        return edges.join(frontier.select(F.col("node").alias("source"), F.col("ordinal").alias("source_order")), "source")

    return references.bounded_closure(seeds, expand, 2).select("node", "level")


@query(
    """with recursive r as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as i,
      sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding)::int as e, l_quantity::int as q from lineitem),
    f as (select k, i, e - q + 1 as s, e, 0 as c from r where i = 1
      union all select r.k, r.i, case when r.e - f.s + 1 <= 60 then f.s else r.e - r.q + 1 end, r.e, case when r.e - f.s + 1 <= 60 then f.c else f.c + 1 end from f join r on r.k = f.k and r.i = f.i + 1)
    select k as l_orderkey, c as chunk_index, min(s) as start_line, max(e) as end_line, count(*) as n_ranges from f group by k, c"""
)
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")))).alias("rows"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{chunking.RANGE}>").alias("out"))
    placed = F.aggregate(
        "rows", start, lambda a, r: F.struct((a["at"] + r["q"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + 1).alias("start"), (a["at"] + r["q"]).alias("end"), F.array(r["l_linenumber"].cast("string")).alias("names")))).alias("out")), lambda a: a["out"]
    )
    merged = lines.select("l_orderkey", F.posexplode(chunking.merge_greedy(placed, F.lit(60))).alias("chunk_index", "r"))
    return merged.select("l_orderkey", "chunk_index", F.col("r.start").alias("start_line"), F.col("r.end").alias("end_line"), F.size("r.names").cast("long").alias("n_ranges"))


@query("select doc_id, sha256(coalesce(text, '')) as content_hash, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::int as line_count from documents")
def doc_hash_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    return tree.with_hash(docs.withColumn("content_bytes", F.col("content").cast("binary"))).select("doc_id", "content_hash", "line_count")


@query(
    """with a as (select doc_id, md5(text) as h from documents where lang <> 'fr'), b as (select doc_id, md5(text || case when lang = 'de' then 'x' else '' end) as h from documents where source <> 'src0')
    select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'add' when a.doc_id is null then 'remove' when a.h is distinct from b.h then 'update' else 'keep' end as op
    from a full outer join b on a.doc_id = b.doc_id"""
)
def registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    current = docs.where("lang <> 'fr'").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    stored = docs.where("source <> 'src0'").select("doc_id", F.md5(F.concat("text", F.when(F.col("lang") == "de", "x").otherwise("")).cast("binary")).alias("h"))
    return delta.diff(current, stored, "doc_id", "h")


_PATH = "regexp_extract(url, '^https?://([^?#]*)', 1)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))


@query(
    f"""with p as (select page_id, {_PATH} as path, regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) as rel from pages)
    select page_id, rel from p where not (rel = 'fr' or starts_with(rel, 'fr/')) and (rel = 'en' or starts_with(rel, 'en/') or rel = 'de' or starts_with(rel, 'de/') or rel = 'fr' or starts_with(rel, 'fr/'))"""
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1).alias("rel"))
    return pages.where(paths.in_scope(F.col("rel"), ["fr"], ["en", "de", "fr"]))


@query(f"with p as (select page_id, {_PATH} as path from pages) select page_id, array_to_string(list_slice(string_split(path, '/'), 1, 3), '/') as path_module, split_part(path, '/', 1) as path_root, len(string_split(path, '/'))::int as depth from p")
def path_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("page_id", paths.path_module(p).alias("path_module"), paths.path_root(F.lit(""), p).alias("path_root"), F.size(F.split("path", "/", -1)).alias("depth"))


def _role_sql() -> str:
    return "case " + " ".join(f"when ends_with(path, '{s}') then '{r}'" for s, r in roles.SUFFIX_ROLES) + " else 'other' end"


_ENDINGS = [s for s, _ in roles.SUFFIX_ROLES] + ["Thing.kt", ".kts", "Model.java"]
_NAMED = "select p_partkey, p_brand || '/' || replace(p_name, ' ', '') || list_extract([" + ", ".join(f"'{e}'" for e in _ENDINGS) + f"], (p_size % {len(_ENDINGS)} + 1)::int) as path from part"


@query(f"with p as ({_NAMED}) select p_partkey, path, {_role_sql()} as role from p")
def suffix_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_size") % len(_ENDINGS) + 1).cast("int"))
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("")), ending).alias("path"))
    return named.select("p_partkey", "path", roles.arch_role(F.col("path")).alias("role"))


_TYPES = ["view", "click", "cart", "purchase", "search", "login"]
_MATRIX = (
    "with m as (select user_id, count(*) as total_files, round(sum(value), 4) as total, "
    + ", ".join(f"bool_or(event_type = '{t}') as has_{t}" for t in _TYPES)
    + " from events group by user_id), s as (select user_id, total_files, "
    + " + ".join(f"(has_{t})::int" for t in _TYPES)
    + f" as present, round(({' + '.join(f'(has_{t})::int' for t in _TYPES)}) / {len(_TYPES)}.0, 6) as score from m) "
)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return modules.layer_matrix(events, "user_id", {t: F.col("event_type") == t for t in _TYPES}, F.col("event_type"))


@query(_MATRIX + "select user_id, total_files, present::int as present, score from s")
def layer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).select("user_id", "total_files", F.size("present").alias("present"), F.round("score", 6).alias("score"))


@query(_MATRIX + "select user_id, total_files, score from s order by score desc, total_files desc, user_id limit 1")
def best_exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.best_exemplar(_matrix(spark, sf_dir).withColumnRenamed("user_id", "module_path")).select(F.col("module_path").alias("user_id"), "total_files", F.round("score", 6).alias("score"))


@query("select source, count(*) as files, contains(lower(source), 'core') or contains(lower(source), 'shared') or contains(lower(source), 'common') as is_core, contains(lower(source), 'feature') as is_feature from documents group by source")
def module_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.module_counts(table(spark, sf_dir, "documents"), "source").drop("is_other")


@query("select distinct p_name, round(length('red') / length(translate(lower(p_name), '_-/', ''))::double, 6) as score from part where contains(translate(lower(p_name), '_-/', ''), 'red')")
def fuzzy_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return modules.feature_matches(names, "R_e-D", "p_name").select("p_name", F.round("score", 6).alias("score"))


@query(
    f"""with p as (select page_id, {_PATH} as path from pages), m as (select distinct regexp_extract(path, '^([^/]*/[^/]*)/', 1) as dir from p where starts_with(regexp_extract(path, '^[^/]*/([^/]*)/', 1), 'e') union select distinct split_part(path, '/', 1) from p where path like 'm.%'),
    x as (select page_id, path, max(length(dir)) as n from p join m on starts_with(path, dir || '/') and dir <> '' group by page_id, path)
    select p.page_id, coalesce(left(p.path, n), '') as build_module from p left join x on p.page_id = x.page_id"""
)
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _paths(spark, sf_dir)
    deep = pages.select(F.regexp_extract("path", "^([^/]*/[^/]*)/", 1).alias("path"), F.regexp_extract("path", "^[^/]*/([^/]*)/", 1).alias("lang")).where("startswith(lang, 'e')").select("path")
    hosts = pages.where("path like 'm.%'").select(F.substring_index("path", "/", 1).alias("path"))
    return _nearest(pages, deep.union(hosts).distinct())


def _nearest(pages: DataFrame, found: DataFrame) -> DataFrame:
    distinct = pages.select(F.col("path").alias("file_path")).distinct()
    placed = tree.nearest_module(distinct, found)
    return pages.join(placed, pages["path"] == placed["file_path"]).select("page_id", "build_module")


@query("select conv_id, role, turn, found from (select conv_id, role, turn, min(turn) over (partition by conv_id, role) as first, md5(coalesce(text, '')) as found from conversations) where turn = first")
def sibling_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("name", F.concat_ws("/", F.col("conv_id").cast("string"), "role"))
    wanted = turns.groupBy("name").agg(F.first("conv_id").alias("conv_id"), F.first("role").alias("role"), F.min("turn").alias("turn"))
    return modules.find_named(turns, wanted, F.col("name"), F.col("turn"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).select("conv_id", "role", "turn", "found")


@query(
    """with e as (select user_id, floor(epoch(ts))::bigint as s, floor(epoch(ts))::bigint + 21600 as t from events), r as (select *, max(t) over (partition by user_id order by s, t rows between unbounded preceding and 1 preceding) as reach from e),
    i as (select *, sum(case when s <= reach + 2 then 0 else 1 end) over (partition by user_id order by s, t rows unbounded preceding) as island from r)
    select user_id, min(s) as s, max(t) as t from i group by user_id, island"""
)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    spans = table(spark, sf_dir, "events").select("user_id", F.struct(at.cast("int").alias("s"), (at + 21600).cast("int").alias("e")).alias("r")).groupBy("user_id").agg(F.array_sort(F.collect_list("r")).alias("spans"))
    return spans.select("user_id", F.explode(intervals.join_near(F.col("spans"))).alias("r")).select("user_id", F.col("r.s").cast("long").alias("s"), F.col("r.e").cast("long").alias("t"))


@query(
    """select l_orderkey, count(*) as n, round(max(running), 2) as used from (select l_orderkey, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) as running from lineitem) where running <= 100 group by l_orderkey"""
)
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    spans = orders.select("l_orderkey", intervals.within_budget(F.transform("rows", lambda r: F.struct(F.lit(1).alias("s"), r["q"].alias("e"))), 100).alias("kept"))
    used = F.aggregate("kept", F.lit(0), lambda n, r: n + r["e"])
    return spans.where(F.size("kept") > 0).select("l_orderkey", F.size("kept").cast("long").alias("n"), F.round(used.cast("double"), 2).alias("used"))


@query(
    """with a as (select c_nationkey as k, 0 as part, c_custkey as rank, c_name as name from customer union all select s_nationkey, 1, s_suppkey, s_name from supplier)
    select k, part, rank, name from (select *, row_number() over (partition by k order by part, rank, name) as i from a where k not in (select n_nationkey from nation where n_regionkey = 3)) where i = 1"""
)
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("rank"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("rank"), F.col("s_name").alias("name"))
    removed = table(spark, sf_dir, "nation").where("n_regionkey = 3").select(F.col("n_nationkey").alias("k"))
    return unions.ordered_union([a, b], "k", "rank", removed)


@query(
    """select page_id, len(a)::int as n, array_to_string(list_transform(list_zip(a, b), lambda x: x[1] || ': ' || x[2]), '|') as pairs
    from (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as a, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as b from pages)"""
)
def regex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda k: F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(k))
    pairs = F.transform(F.arrays_zip(found(1).alias("a"), found(2).alias("b")), lambda x: F.concat(x["a"], F.lit(": "), x["b"]))
    return table(spark, sf_dir, "pages").select("page_id", F.size(pairs).alias("n"), F.array_join(pairs, "|").alias("pairs"))


@query(
    """with d as (select doc_id, text, case when ends_with(text, chr(10)) then list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) else string_split(text, chr(10)) end as l from documents)
    select doc_id, md5(case when len(l) > 3 then array_to_string(list_slice(l, 1, 3), chr(10)) || chr(10) || '// ... (truncated)' else text end) as head_md5, len(l)::int as n_lines from d"""
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.head(t, 3).cast("binary")).alias("head_md5"), F.size(text.lines(t)).alias("n_lines"))


@query("select distinct source from documents order by source")
def distinct_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.distinct_modules(table(spark, sf_dir, "documents"), "source")


@query(_LINKS + "select count(*) as edges, count(distinct page_id) as sources, count(distinct target) as targets from e")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).distinct().agg(F.count("*").alias("edges"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


from . import code_queries  # noqa: E402, F401  adds its queries
