"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.withColumnsRenamed({"id": "vec_id", "component": "component_id"})


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id").drop("score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenfile import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0), n=10).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_mixing, op3_simhash, op4_bpe, op5_embeddings, op6_quality, op7_secrets, op8_pii, op9_substring, op10_token_files, op11_ann, op12_merkle, op13_filter_audit)}
#: The same in DuckDB, for what SQL can say.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
with p as (select page_id, coalesce(html, '') as body from pages), d as (select page_id, strlen(body)::bigint as n, sha1(body) as digest from p),
top as (select digest, max(page_id) as kept from d where n >= 1000 group by digest),
r as (select d.*, case when page_id < kept then kept end as other from d left join top on d.digest = top.digest and n >= 1000)
select page_id, n as payload_bytes, digest as payload_digest, case when other is null then 'response' else 'revisit' end as record_type, other as refers_to from r""",
    "op5_embeddings": """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
u as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from reach group by a), n as (select a as vec_id, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from v join c using (vec_id) left join n using (vec_id)""",
    "op9_substring": """
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from w, unnest(range(1, greatest(1, len(ws) - 11))) as t(i)),
least as (select g, min(doc_id) as m from win group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join least using (g) where m < doc_id),
lists as (select doc_id, list(p) as ps, count(*) as n_removed from gone group by doc_id),
k as (select w.doc_id, ws, coalesce(ps, []) as ps, coalesce(n_removed, 0) as n_removed from w left join lists using (doc_id))
select doc_id, len(ws)::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(list_filter(ws, lambda x, i: not list_contains(ps, i)), ' ')) as kept_sha256 from k""",
    "op12_merkle": """
with recursive f as (select doc_id, case when source is null then '0' else '1' || source end as tree, source, lang, n_chars, text,
  list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::ubigint, 1000, 1000, 1000, 1000, 1000, 1000, 1000, 1000]))),
    lambda r, b: case when b < 1000 then xor(r, b) when r % 2 = 1 then xor(r >> 1, 3988292384::ubigint) else r >> 1 end) % 2 = 1 as even from documents),
l as (select doc_id, tree, even and contains(coalesce(text, ''), chr(10)) as changed,
  coalesce(octet_length(doc_id::varchar::blob) || ':' || doc_id, '-') || coalesce(octet_length(source::blob) || ':' || source, '-') || coalesce(octet_length(lang::blob) || ':' || lang, '-') || coalesce(octet_length(n_chars::varchar::blob) || ':' || n_chars, '-') as head,
  coalesce(strlen(text) || ':' || text, '-') as body, replace(text, chr(10), '') as cut from f),
leaves as (select doc_id, tree, sha256(head || body) as leaf, case when changed then sha256(head || strlen(cut) || ':' || cut) end as tampered from l),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaves),
low(tree, lv, pos, n, node) as (select tree, 0, pos, n, leaf from p union all
  select tree, lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' order by pos)) from low where n > 1 group by tree, lv, pos // 3, n),
subroots as (select tree, node as subroot, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as n from low where n = 1),
high(lv, pos, n, node) as (select 0, pos, n, subroot from subroots union all select lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' order by pos)) from high where n > 1 group by lv, pos // 3, n),
root as (select node as root from high where n = 1),
steps as (select p.tree, p.pos as leaf_pos, low.lv as lv, p.pos // (3 ** low.lv)::bigint as own, string_agg(low.node, '' order by low.pos) filter (low.pos < p.pos // (3 ** low.lv)::bigint) as lower_, string_agg(low.node, '' order by low.pos) filter (low.pos > p.pos // (3 ** low.lv)::bigint) as upper_
  from p join low on low.tree = p.tree and low.n > 1 and low.pos // 3 = p.pos // (3 ** (low.lv + 1))::bigint group by 1, 2, 3, 4),
heights as (select tree, max(lv) as h from low group by tree),
more as (select s.tree, high.lv as lv, s.pos // (3 ** high.lv)::bigint as own, string_agg(high.node, '' order by high.pos) filter (high.pos < s.pos // (3 ** high.lv)::bigint) as lower_, string_agg(high.node, '' order by high.pos) filter (high.pos > s.pos // (3 ** high.lv)::bigint) as upper_
  from subroots s join high on high.n > 1 and high.pos // 3 = s.pos // (3 ** (high.lv + 1))::bigint group by 1, 2, 3),
way as (select tree, leaf_pos, lv, coalesce(lower_, '') as lower_, coalesce(upper_, '') as upper_ from steps
  union all select p.tree, p.pos, h + lv, coalesce(lower_, ''), coalesce(upper_, '') from p join more using (tree) join heights using (tree)),
proofs as (select tree, leaf_pos, sha256(string_agg(lower_ || upper_, '' order by lv)) as proof from way group by 1, 2),
fold(tree, leaf_pos, lv, node) as (select tree, pos, 0::bigint, coalesce(tampered, leaf) from p union all
  select f.tree, f.leaf_pos, f.lv + 1, sha256(w.lower_ || f.node || w.upper_) from fold f join way w on w.tree = f.tree and w.leaf_pos = f.leaf_pos and w.lv = f.lv),
folded as (select tree, leaf_pos, max_by(node, lv) as folded_root from fold group by 1, 2)
select p.doc_id, p.leaf, s.subroot, root.root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = root.root as verified
from p join subroots s using (tree) cross join root left join proofs r on r.tree = p.tree and r.leaf_pos = p.pos join folded f on f.tree = p.tree and f.leaf_pos = p.pos""",
    "op13_filter_audit": """
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
f as (select doc_id, part, (len(ws) < 200)::int as a, (100 * len(list_distinct(ws)) < 50 * len(ws))::int as b, (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::int as c, regexp_matches(t, '[#$%&*|]')::int as d, coalesce(doc_id > min(doc_id) over (partition by t), false)::int as e from w),
k as (select doc_id, bool_or(coalesce(quality, 0) = 1) as good, bool_or(coalesce(toxic, 0) = 1) as toxic from labels group by 1),
m as (select part, a + 2 * b + 4 * c + 8 * d + 16 * e as mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic from f left join k using (doc_id)),
h as (select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from m group by 1, 2),
ls as (select unnest(['A', 'B', 'C', 'D', 'E']) as l), o as (select a.l || b.l || c.l || d.l || e.l as filter_order from ls a, ls b, ls c, ls d, ls e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s as (select filter_order, step, (1 << (ascii(filter_order[step]) - 65)) as own, list_sum(list_transform(range(1, step), lambda i: (1 << (ascii(filter_order[i]) - 65)))) as before from o, range(1, 6) r(step)),
q as (select part, filter_order, step, own, sum(n) filter (mask & (coalesce(before, 0) + own)::int = 0) as kept, sum(n) filter (mask & coalesce(before, 0)::int = 0 and mask & own <> 0) as removed, sum(n) filter (mask & coalesce(before, 0)::int <> 0 and mask & own <> 0) as redundant,
  sum(n) filter (mask = own) as u, sum(g) filter (mask & coalesce(before, 0)::int = 0 and mask & own <> 0) as gl, sum(x) filter (mask & coalesce(before, 0)::int = 0 and mask & own <> 0) as tl from h, s group by 1, 2, 3, 4)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(u, 0)::bigint as unique_fails, coalesce(gl, 0)::bigint as good_lost, coalesce(tl, 0)::bigint as toxic_lost, sum(coalesce(removed, 0)) over (partition by part, own)::bigint as shapley from q""",
}
