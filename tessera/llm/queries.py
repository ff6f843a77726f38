"""The queries over the operators of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import classlm, decontamination, divergence, exactspans, extraction, mixing, nearest, passages, projections, sharding, simhash, spellings, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op2_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classed(passages.shared_passages(_read(spark, sf_dir, "documents")))


def op6_column_wise_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactspans.remove_repeats(_read(spark, sf_dir, "documents")).drop("spans")


def op7_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(_read(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("source", "before")


def op9_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return classlm.score(_read(spark, sf_dir, "documents"), held_out)


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    s = toxicity.Settings()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.train(docs, labels, ~held_out, s, in_task=True)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= s.threshold, 1).otherwise(0).alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.group(_read(spark, sf_dir, "documents"))


def op13_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_vectors(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_bin_packing": op1_vector_bin_packing,
    "op2_one_bit_codes": op2_one_bit_codes,
    "op3_simhash_anchors": op3_simhash_anchors,
    "op4_containment_search": op4_containment_search,
    "op5_collinear_chains": op5_collinear_chains,
    "op6_column_wise_suffixes": op6_column_wise_suffixes,
    "op7_host_wrappers": op7_host_wrappers,
    "op8_source_mixing": op8_source_mixing,
    "op9_class_ngrams": op9_class_ngrams,
    "op10_subword_toxicity": op10_subword_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sorted_projections": op13_sorted_projections,
}

ORACLE_SQL: dict[str, str] = {
    "op2_one_bit_codes": """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), p as (
  select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from p qualify rank <= 20
""",
    "op4_containment_search": r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark
), k as (
  select 5 as k union select len(w) from b where len(w) between 1 and 4
), ds as (
  select distinct doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from d join k on len(w) >= k
), bs as (
  select distinct item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) as s from b where len(w) > 0
), n as (select item_id, count(*) as n_item from bs group by item_id)
select doc_id, item_id, n_item, count(*) as n_shared, count(*) / n_item::double as containment
from ds join bs using (s) join n using (item_id) group by doc_id, item_id, n_item having count(*) >= 0.8 * n_item
""",
    "op8_source_mixing": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')), 1, 15))::bigint as k
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select source, source_size, source_size * 3 as cap,
         case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end::bigint as weight
  from s
), o as (
  select *, coalesce(sum(cap) over b, 0) as capped, coalesce(sum(weight) over b, 0) as used
  from w window b as (order by cap::double / weight, source asc nulls last rows between unbounded preceding and 1 preceding)
), l as (
  select max(((select sum(source_size) from s) - capped)::double / ((select sum(weight) from w) - used)) as level from o
), t as (
  select source, source_size, least(cap::double, weight * level) as target from w, l
), p as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
         sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls last, d.size rows unbounded preceding) - d.size as ahead
  from d join t on d.source is not distinct from t.source
), e as (
  select *, case when source_size > 0 then least(budget // source_size, 3) else 0 end as epochs from p
)
select doc_id, size, source_size, target,
       (size * epochs + greatest(0, least(size, budget - epochs * source_size - ahead)))::bigint as taken
from e
""",
    "op11_source_divergence": r"""
with d as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), t as (select doc, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*)::hugeint as n from t group by lang, term having count(distinct doc) >= 10),
c as (select lang, source, term, count(*)::hugeint as n from t join k using (lang, term) group by lang, source, term),
l as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by lang),
g as (
  select d.lang, d.source, coalesce(max(l.v), 0)::hugeint as v, coalesce(max(l.total), 0)::hugeint as lang_total,
         coalesce((select sum(c.n) from c where c.lang = d.lang and c.source = d.source), 0)::hugeint as total
  from d left join l using (lang) group by d.lang, d.source
),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) as p,
         1 + (1000000000::hugeint * (k.n + 2)) // (g.lang_total + 2 * g.v) as q
  from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
s as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::bigint as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p where n > 0 and p > q
)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
from r qualify part = 'pair' or rank <= 10
""",
    "op13_sorted_projections": """
with recursive v as (
  select row_number() over () as i, vec_id, embedding::double[] as e from embeddings
), u as (
  select * from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), l as (
  select a.i, b.i as j, b.vec_id from u a join u b on a.i <> b.i and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), c as (
  select i, i as j, vec_id from u union select c.i, l.j, l.vec_id from c join l on c.j = l.i
), m as (select i, min(vec_id) as component_id from c group by i), n as (select i, count(*) as n from l group by i)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from v left join m using (i) left join n using (i)
""",
}
