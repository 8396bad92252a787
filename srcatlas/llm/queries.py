"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, digest, embed, html, jaccard, langid, lm, mixing, planes, quality
from .shared import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source", "source_size", F.round("target", 4).alias("target"), "taken", "copies", F.round("first_position", 6).alias("first_position"), F.round("last_position", 6).alias("last_position")
    )


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_next(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_lm_scores, op3_quality, op4_near_vectors, op5_jaccard_join, op6_binary_ids, op7_main_text, op8_bpe, op9_language, op10_fingerprints)}

_OP1 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(doc_id::varchar, '')) as o from documents),
s as (select source, sum(size) as source_size, row_number() over (order by source nulls last) as r from d group by source),
w as (select *, [5.0, 2.0, 1.0][(r - 1) % 3 + 1]::double as weight, [0.5, 0.0, -0.5][(r - 1) % 3 + 1]::double as tilt, source_size * 2 as most from s),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(most) over (order by most / weight, r rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by most / weight, r rows between current row and unbounded following) as level from w),
v as (select (array_agg(level order by most / weight, r) filter (where level * weight <= most))[1] as level from l),
t as (select l.source, source_size, tilt, least(most::double, coalesce(weight * v.level, most::double)) as target from l, v),
p as (select d.*, t.source_size, t.tilt, t.target, round(t.target)::bigint as goal, coalesce(sum(size) over (partition by d.source order by o, doc_id rows between unbounded preceding and 1 preceding), 0) as place from d join t on d.source is not distinct from t.source),
k as (select *, greatest(0, least(size, goal - place)) as a, greatest(0, least(size, goal - source_size - place)) as b from p),
c as (select *, (a > 0)::int + (b > 0)::int as copies from k),
y as (select *, case when target > 0 then least(place / target, 1.0) else 0.0 end as y0, case when target > 0 then least((place + source_size * (copies - 1)) / target, 1.0) else 0.0 end as y1 from c)
select doc_id, size::bigint as size, source, source_size::bigint as source_size, round(target, 4) as target, (a + b)::bigint as taken, copies,
case when copies > 0 then round(2 * y0 / ((1 + tilt) + sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * y0, 0))), 6) end as first_position,
case when copies > 0 then round(2 * y1 / ((1 + tilt) + sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * y1, 0))), 6) end as last_position
from y
"""

_OP4 = """
with recursive v as (select vec_id, embedding as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings),
k as (select vec_id, list_transform(e, lambda x: x::double / n) as u from v where n > 0),
l as (select a.vec_id as a, b.vec_id as b from k a join k b on a.vec_id <> b.vec_id where list_sum(list_transform(list_zip(a.u, b.u), lambda x: x[1] * x[2])) >= 0.9),
r as (select vec_id as node, vec_id as root from embeddings union select l.b, r.root from r join l on r.node = l.a),
c as (select node, min(root) as component_id from r group by node), d as (select a, count(*) as n from l group by a)
select vec_id, coalesce(d.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join c on node = vec_id left join d on a = vec_id
"""

_OP5 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
l as (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r as (select doc_id as node, doc_id as root from documents union select l.b, r.root from r join l on r.node = l.a),
c as (select node, min(root) as component_id from r group by node)
select doc_id, len(s)::bigint as n_shingles, component_id from s join c on node = doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": _OP1, "op4_near_vectors": _OP4, "op5_jaccard_join": _OP5}
