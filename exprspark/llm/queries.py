"""The registered queries over whole document tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprspark.llm import common, decontam, dualtree, licenses, mixing, neardup, packing, pii, secrets, shallot, sharding, tiff, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return neardup.near_duplicates(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op2_near_duplicates"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.c = e.a),
m as (select doc_id, min(c) as component_id from r group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from m left join n using (doc_id)
"""


@query
def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, verbatim or with other numbers, names or units."""
    return decontam.leaks(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark")).drop("text_key")


@query
def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document on a ring of 8 shards with bounded loads."""
    return sharding.shard(common.documents(spark, sf_dir))


@query
def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target of every source and the words taken of every document."""
    return mixing.mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fold."""
    return toxicity.toxicity(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


@query
def op1_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with the digest of the base kinds."""
    return secrets.scan(common.documents(spark, sf_dir))


@query
def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, with the digest of the base kinds."""
    return pii.redactions(common.documents(spark, sf_dir))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokens.token_counts(common.documents(spark, sf_dir))


@query
def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as TIFF and read back."""
    return tiff.text_media(common.documents(spark, sf_dir))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory."""
    return licenses.scan(licenses.document_files(common.documents(spark, sf_dir))).drop("text")


_TEMPLATES = ", ".join("('%s', '%s', '%s')" % (f"{i:03d}", name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))
ORACLES["op6_license_scan"] = rf"""
with f as (
  select doc_id, source || '/' || case when b = 0 then '' when b <= 4 then lang || '/' else lang || '/' || cast(doc_id // 1000 as varchar) || '/' end
    || case when contains(lower(split_part(text, chr(10), 1)), 'licen') then 'LICENSE.' || cast(doc_id as varchar) else cast(doc_id as varchar) || '.txt' end as path, text
  from (select *, length(text) - length(replace(text, chr(10), '')) as b from documents)),
tp(template, license, body) as (values {_TEMPLATES}),
tt as (select template, license, term, count(*) as tf from (select template, license, unnest(regexp_extract_all(lower(body), '{licenses.TERM}')) as term from tp) group by 1, 2, 3),
n as (select count(*) as total from f),
d as (select term, count(*) as df from (select distinct path, unnest(regexp_extract_all(lower(text), '{licenses.TERM}')) as term from f) group by 1),
i as (select distinct term, ln((total + 1.0) / (coalesce(df, 0) + 1)) + 1 as idf from (select distinct term from tt) left join d using (term), n),
tw as (select template, license, term, tf * idf as weight from tt join i using (term)),
tn as (select template, sqrt(sum(weight * weight)) as norm from tw group by 1),
l as (select distinct path, unnest(string_split(text, chr(10))) as line from f),
w as (select path, line, term, count(*) * coalesce(max(idf), (select ln(total + 1.0) + 1 from n)) as x
  from (select path, line, unnest(regexp_extract_all(lower(line), '{licenses.TERM}')) as term from l) left join i using (term) group by 1, 2, 3),
len as (select path, line, sqrt(sum(x * x)) as size from w group by 1, 2),
s as (select path, license, max(round(dot / (norm * size), 6)) as score from (
  select path, line, template, license, sum(x * weight) as dot from w join tw using (term) group by 1, 2, 3, 4) join tn using (template) join len using (path, line) group by 1, 2),
own as (select path, arg_max(license, (score, -rn)) as license, max(score) as score from (select *, row_number() over (order by license) as rn from s where score >= {licenses.THRESHOLD}) group by 1),
g as (select *, regexp_replace(path, '/?[^/]*$', '') as dir from f),
ld as (select dir, arg_max(license, (score, -rn)) as dir_license from (
  select dir, license, own.score, row_number() over (order by license) as rn from own join g using (path) where regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENCE_FILE}')) group by 1),
a as (select g.path, arg_max(ld.dir, length(ld.dir)) as dir, arg_max(dir_license, length(ld.dir)) as dir_license from g join ld on g.dir = ld.dir or starts_with(g.dir, ld.dir || '/') group by 1)
select doc_id, f.path, coalesce(own.license, dir_license) as license, case when own.license is not null then 'header' when dir_license is not null then 'inherited' end as origin,
  own.score, case when own.license is null then a.dir end as license_dir
from f left join own using (path) left join a using (path)
"""


@query
def op12_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five exact rounds."""
    return shallot.cluster(common.table(spark, sf_dir, "embeddings"))


def _cluster_sql() -> str:
    steps = [f"""c0 as materialized (select r - 1 as c, i, x from (select *, dense_rank() over (order by sha256('2:' || cast(vec_id as varchar))) as r from v) where r <= {shallot.CLUSTERS})"""]
    for r in range(shallot.ROUNDS + 1):
        steps.append(f"d{r} as (select vec_id, c, sum((v.x - k.x) * (v.x - k.x)) as d from v join c{r} k using (i) group by 1, 2)")
        steps.append(f"a{r} as materialized (select vec_id, arg_min(c, (d, c)) as c, min(d) as d from d{r} group by 1)")
        if r < shallot.ROUNDS:
            steps.append(f"""m{r} as (select c, i, sum(x)::hugeint as s, count(*) as n from a{r} join v using (vec_id) group by 1, 2)""")
            steps.append(f"""c{r + 1} as materialized (select k.c, k.i, case when n is null then k.x else s // n - case when s % n < 0 then 1 else 0 end end as x from c{r} k left join m{r} m on k.c = m.c and k.i = m.i)""")
    n = shallot.ROUNDS
    return f"""
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as materialized (select vec_id, unnest(range(64)) as i, unnest(q) as x from e),
{", ".join(steps)},
s as (select c, sha256(string_agg(cast(x::bigint as varchar), ',' order by i)) as h from c{n} group by 1),
t as (select c, sum(d)::bigint as ci from a{n} group by 1)
select vec_id, c::int as cluster, d::bigint as distance, ci as cluster_inertia, (select sum(d)::bigint from a{n}) as inertia, h as centroid_sha256
from a{n} join s using (c) join t using (c)
"""


ORACLES["op12_shallot_clusters"] = _cluster_sql()


@query
def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return dualtree.ranked_search(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


ORACLES["op11_dual_tree_search"] = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
s as (select count(*) as total, sum(len(ws))::bigint as length from d where len(ws) > 0),
f as (select r, doc_id, t, count(*) as tf from (select r, doc_id, unnest(ws) as t from d) where t in (select t from q) group by 1, 2, 3),
w as (select t, floor(1000 * ln((2 * total + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, s group by t, total),
m as (select r, 10 + (90 * len(ws) * total) // length as m from d, s),
x as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join w using (t) join f using (t) join m using (r) group by 1, 2, 3)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from x where score > 0) where rank <= 10
"""


@query
def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 4096."""
    pieces = packing.pack_texts(common.documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment", "loss")
