"""Quality control, exploration, differential testing, enrichment, scoring and composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.functions.text import rounded
from exprspark.operators import associate as A
from exprspark.operators import cluster as K
from exprspark.operators import counts as N
from exprspark.operators import decon as D
from exprspark.operators import design as X
from exprspark.operators import enrich as E
from exprspark.operators import linear as L
from exprspark.operators import matrix as M
from exprspark.operators import qc as Q
from exprspark.operators import results as R
from exprspark.operators import score as S
from exprspark.plans.registry import query


def show(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Keys as they are, every other double rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(F.col(c), digits).alias(c) if c not in keys and kinds[c] == "double" else F.col(c) for c in df.columns])


# ---- quality control

QC = """qc as (select sample_id, sum(value) as library_size, count(*) filter (value > 0) as detected_features from m_counts group by 1),
 f as (select count(distinct feature_id) as k from m_counts),
 qcm as (select sample_id, round(library_size, 8) as library_size, detected_features, round(detected_features / k, 8) as detected_fraction, round(1 - detected_features / k, 8) as zero_fraction from qc, f)"""


@query("qc_sample_metrics", "m_counts", sql=f", {QC} select * from qcm")
def _(v):
    return Q.sample_qc(v.counts_once)


@query("qc_sample_flags", "m_counts", sql=f""", {QC}, m as (select median(library_size) as ml, median(detected_features) as md from qcm),
 g as (select qcm.*, ml > 0 and library_size < ml * 0.2 as a, md > 0 and detected_features < md * 0.5 as b from qcm, m)
 select * exclude (a, b), case when a or b then 'REVIEW' else 'PASS' end as status, concat_ws(';', case when a then 'LOW_LIBRARY_SIZE' end, case when b then 'LOW_DETECTED_FEATURES' end) as reasons from g""")
def _(v):
    return Q.flag_samples(Q.sample_qc(v.counts_once))


@query("qc_nation_flags", "m_nation", sql=f""", {QC.replace("m_counts", "m_nation")}, m as (select median(library_size) as ml, median(detected_features) as md from qcm),
 g as (select qcm.*, ml > 0 and library_size < ml * 0.2 as a, md > 0 and detected_features < md * 0.5 as b from qcm, m)
 select sample_id, case when a or b then 'REVIEW' else 'PASS' end as status, concat_ws(';', case when a then 'LOW_LIBRARY_SIZE' end, case when b then 'LOW_DETECTED_FEATURES' end) as reasons from g""")
def _(v):
    return Q.flag_samples(Q.sample_qc(v.nation_counts)).select("sample_id", "status", "reasons")


LOGCPM = "lc as (select feature_id, sample_id, log2(value / sum(value) over (partition by sample_id) * 1e6 + 1) as value from m_counts)"


@query("qc_log_cpm", "m_counts", sql=f", {LOGCPM} select feature_id, sample_id, round(value, 6) as value from lc")
def _(v):
    return show(Q.log_cpm(v.counts_once))


@query("qc_raw", "m_counts", "m_feat", sql="""select sample_id, sum(value) as library_size, count(*) filter (value > 0) as detected_genes, round(100.0 * count(*) filter (value > 0) / (select count(distinct feature_id) from m_counts), 6) as detected_genes_percent,
 round(any_value(100.0 * ok / greatest(n, 1)), 6) as mapping_rate_percent, sum(case when biotype = 'SMALL' then value else 0 end) as mitochondrial_counts, round(100 * sum(case when biotype = 'SMALL' then value else 0 end) / sum(value), 6) as mitochondrial_percent,
 sum(case when symbol = 'Brand#7' then value else 0 end) as ribosomal_counts, round(100 * sum(case when symbol = 'Brand#7' then value else 0 end) / sum(value), 6) as ribosomal_percent
 from m_counts join m_feat using (feature_id) join (select cast(l_suppkey as varchar) as sample_id, count(*) as n, count(*) filter (l_returnflag = 'N') as ok from lineitem group by 1) using (sample_id) group by 1""")
def _(v):
    feat = v.feat.select("feature_id", F.when(F.col("biotype") == "SMALL", "chrM").otherwise("chr1").alias("seqname"),
                         F.when(F.col("symbol") == "Brand#7", "Mt_rRNA").otherwise("protein_coding").alias("gene_type"))
    stats = v.table("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("sample_id")).agg(
        F.count(F.lit(1)).alias("num_processed"), F.count_if(F.col("l_returnflag") == "N").alias("num_mapped"))
    return show(Q.raw_qc(v.counts, feat, stats))


CORR = """g as (select n.sample_id as sample_id, f.feature_id, coalesce(c.value, 0) as v from (select distinct sample_id from {t}) n cross join (select distinct feature_id from {t}) f left join {t} c on c.sample_id = n.sample_id and c.feature_id = f.feature_id)"""


@query("qc_mean_sample_corr", "m_counts", sql=f""", {CORR.format(t='m_counts')}, c as (select a.sample_id, corr(ln(a.v + 1), ln(b.v + 1)) as r from g a join g b using (feature_id) where a.sample_id <> b.sample_id group by a.sample_id, b.sample_id)
 select sample_id, round(avg(r), 6) as mean_correlation from c group by 1""")
def _(v):
    return show(Q.mean_sample_corr(v.counts))


@query("qc_pca_distance")
def _(v):
    return show(Q.pca_distance(v.counts))


@query("qc_tukey_flags", "m_counts", sql=f", {QC}, q as (select quantile_cont(library_size, 0.25) as q1, quantile_cont(library_size, 0.75) as q3 from qcm) select sample_id, library_size, library_size < q1 - 3 * (q3 - q1) as outlier from qcm, q")
def _(v):
    return Q.tukey_flags(Q.sample_qc(v.counts_once), "library_size", "lower")


@query("qc_tukey_flags_upper", sql="""with t as (select cast(o_custkey as varchar) as sample_id, sum(o_totalprice) as spent from orders group by 1), q as (select quantile_cont(spent, 0.25) as q1, quantile_cont(spent, 0.75) as q3 from t)
 select sample_id, round(spent, 2) as spent, spent > q3 + 3 * (q3 - q1) as outlier from t, q""")
def _(v):
    spent = v.table("orders").groupBy(F.col("o_custkey").cast("string").alias("sample_id")).agg(F.sum("o_totalprice").alias("spent"))
    return show(Q.tukey_flags(spent, "spent", "upper"), digits=2)


@query("qc_mad_outliers", "m_counts", sql=f""", {QC}, c as (select median(library_size) as m from qcm), d as (select 1.4826 * median(abs(library_size - m)) as mad from qcm, c)
 select sample_id, library_size, round(case when mad > 0 then (library_size - m) / mad else 0 end, 6) as library_size_z from qcm, c, d""")
def _(v):
    return show(Q.robust_z(Q.sample_qc(v.counts_once).select("sample_id", "library_size"), "library_size"), "library_size")


@query("qc_array", "m_region", sql="""select sample_id, round(median(log2(value + 1)), 6) as raw_log2_median, round(quantile_cont(log2(value + 1), 0.75) - quantile_cont(log2(value + 1), 0.25), 6) as raw_log2_iqr,
 round(median(sqrt(value)), 6) as normalized_log2_median, round(quantile_cont(sqrt(value), 0.75) - quantile_cont(sqrt(value), 0.25), 6) as normalized_log2_iqr from m_region group by 1""")
def _(v):
    return show(Q.array_qc(v.region_counts, v.region_counts.withColumn("value", F.sqrt("value"))).drop("status", "reasons"))


@query("qc_merge_status", sql="""select cast(l_suppkey as varchar) as sample_id, case max(case when l_returnflag = 'R' and l_discount = 0.1 then 3 when l_returnflag = 'A' and l_tax = 0.08 then 2 else 1 end) when 3 then 'SEVERE_REVIEW' when 2 then 'REVIEW' else 'PASS' end as status from lineitem group by 1""")
def _(v):
    state = (F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.1), "SEVERE_REVIEW")
             .when((F.col("l_returnflag") == "A") & (F.col("l_tax") == 0.08), "REVIEW").otherwise("PASS"))
    return Q.merge_status(v.table("lineitem").select(F.col("l_suppkey").cast("string").alias("sample_id"), state.alias("status")), ["sample_id"])


KEPT = "kept as (select feature_id from m_counts group by 1 having count(*) filter (value >= 30) >= 12)"


@query("qc_low_count_filter", "m_counts", sql=f", {KEPT} select feature_id, sample_id, value from m_counts where feature_id in (select feature_id from kept)")
def _(v):
    return Q.filter_low_counts(v.counts_once, 30, 12)[0]


@query("qc_low_count_numbers", "m_counts", sql=f", {KEPT} select (select count(*) from kept) as features_kept, count(distinct feature_id) - (select count(*) from kept) as features_filtered from m_counts")
def _(v):
    return Q.filter_low_counts(v.counts_once, 30, 12)[1]


@query("qc_size_factors", "m_region", sql="""select sample_id, round(exp(median(ln(value) - lm)), 6) as size_factor from m_region join (select feature_id, avg(ln(value)) as lm from m_region where value > 0 group by 1 having count(*) = 5) using (feature_id) group by 1""")
def _(v):
    return show(Q.size_factors(v.region_counts))


TMM = """lib as (select sample_id, sum(value) as ls from m_region group by 1), f as (select count(distinct feature_id) as n from m_region),
 dense as (select l.sample_id, x.feature_id, coalesce(value, 0) as value, ls from lib l cross join (select distinct feature_id from m_region) x left join m_region r on r.sample_id = l.sample_id and r.feature_id = x.feature_id),
 q as (select sample_id, quantile_cont(value, 0.75) / any_value(ls) as f75 from dense group by 1), ref as (select arg_min(sample_id, (abs(f75 - (select avg(f75) from q)), sample_id)) as rs from q),
 p as (select d.sample_id, log2(d.value / d.ls / (r.value / r.ls)) as m, (log2(d.value / d.ls) + log2(r.value / r.ls)) / 2 as a, (d.ls - d.value) / d.ls / d.value + (r.ls - r.value) / r.ls / r.value as v
  from dense d join dense r using (feature_id) join ref on r.sample_id = rs where d.value > 0 and r.value > 0),
 k as (select *, rank() over (partition by sample_id order by m) + (count(*) over (partition by sample_id, m) - 1) / 2.0 as rm, rank() over (partition by sample_id order by a) + (count(*) over (partition by sample_id, a) - 1) / 2.0 as ra, count(*) over (partition by sample_id) as n, max(abs(m)) over (partition by sample_id) as far from p),
 w as (select sample_id, case when max(far) < 1e-6 then 0 else sum(m / v) / sum(1 / v) end as lf from k where rm between floor(n * 0.3) + 1 and n + 1 - floor(n * 0.3) - 1 and ra between floor(n * 0.05) + 1 and n + 1 - floor(n * 0.05) - 1 group by 1),
 fac as (select sample_id, ls as library_size, pow(2, coalesce(lf, 0) - avg(coalesce(lf, 0)) over ()) as norm_factor from lib left join w using (sample_id))"""


@query("qc_tmm_factors", "m_region", sql=f", {TMM} select sample_id, library_size, round(norm_factor, 6) as norm_factor from fac")
def _(v):
    return show(Q.tmm_factors(v.region_counts), "library_size")


@query("qc_log_cpm_tmm", "m_region", sql=f""", {TMM}, e as (select sample_id, library_size * norm_factor as lib, avg(library_size * norm_factor) over () as ml from fac)
 select feature_id, sample_id, round(log2((value + 2 * lib / ml) / (lib + 4 * lib / ml) * 1e6), 6) as value from m_region join e using (sample_id)""")
def _(v):
    return show(Q.log_cpm_tmm(v.region_counts, Q.tmm_factors(v.region_counts)))


# ---- exploration

VARS = "n as (select count(distinct sample_id) as n from m_counts), vars as (select feature_id, (sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1) as v from m_counts, n group by 1)"


@query("dim_top_variable", "m_counts", sql=f", {VARS} select feature_id, round(v, 6) as var_samp, row_number() over (order by round(v, 9) desc, feature_id) as rank from vars where v > 0 qualify rank <= 500")
def _(v):
    out = M.top_variable(v.counts, 500)
    return out.select("feature_id", rounded(F.col("var_samp")).alias("var_samp"), "rank")


@query("dim_scaled", "m_embed", sql="select feature_id, sample_id, round((value - avg(value) over (partition by feature_id)) / stddev_samp(value) over (partition by feature_id), 6) as value from m_embed")
def _(v):
    return show(M.scale_features(v.embed))


@query("dim_scaled_population", "m_embed", sql="select feature_id, sample_id, round((value - avg(value) over (partition by feature_id)) / stddev_pop(value) over (partition by feature_id), 6) as value from m_embed")
def _(v):
    return show(M.scale_features(v.embed, ddof=0))


@query("dim_pca")
def _(v):
    return show(M.pca(v.embed, 5).coordinates)


@query("dim_pca_loadings")
def _(v):
    return show(M.pca(v.embed, 5).loadings)


@query("dim_pca_variance", "m_embed", sql="select 64.0 as total_variance, count(distinct feature_id) as features from m_embed")
def _(v):
    """All scaled components together carry one unit of variance per feature."""
    out = M.pca(v.embed, 64).variance
    return out.agg(rounded(F.sum("explained_variance"), 4).alias("total_variance"), F.count(F.lit(1)).alias("features"))


@query("dim_distance_euclid", "m_nation", sql=f""", {CORR.format(t='m_nation')} select a.sample_id as sample_a, b.sample_id as sample_b, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) as distance from g a join g b using (feature_id) where a.sample_id < b.sample_id group by 1, 2""")
def _(v):
    return show(M.pairwise_distance(v.nation_counts))


@query("dim_distance_correlation", "m_nation", sql=f""", {CORR.format(t='m_nation')} select a.sample_id as sample_a, b.sample_id as sample_b, round(1 - corr(a.v, b.v), 6) as distance from g a join g b using (feature_id) where a.sample_id < b.sample_id group by 1, 2""")
def _(v):
    return show(M.pairwise_distance(v.nation_counts, "correlation"))


@query("dim_corr_matrix", "m_counts", sql=f""", {CORR.format(t='m_counts')} select a.sample_id as sample_a, b.sample_id as sample_b, round(corr(a.v, b.v), 6) as correlation from g a join g b using (feature_id) where a.sample_id <= b.sample_id group by 1, 2""")
def _(v):
    return show(M.sample_correlation(v.counts))


@query("dim_linkage")
def _(v):
    return show(K.linkage(M.pairwise_distance(v.nation_counts, "correlation"), "average", "correlation"))


@query("dim_linkage_ward")
def _(v):
    return show(K.linkage(M.pairwise_distance(v.nation_counts), "ward"))


@query("dim_cut_tree")
def _(v):
    return K.cut_tree(K.linkage(M.pairwise_distance(v.nation_counts), "complete"), 4)


# ---- design and differential testing

DESIGN = X.Design(["batch", "covariate", "condition"], categorical=["condition"])


@query("de_design_matrix", "m_meta", sql="""select sample_id, 'Intercept' as term, 1.0::double as x from m_meta union all select sample_id, 'covariate', round(covariate - avg(covariate) over (), 6) from m_meta
 union all select sample_id, 'condition[' || c || ']', (condition = c)::double from m_meta, (select distinct condition as c from m_meta where condition <> 'ASIA')""")
def _(v):
    design = X.Design(["covariate", "condition"], references={"condition": "ASIA"})
    return show(X.design_matrix(v.meta.drop("batch"), design))


@query("de_design_check", sql="select 'ERROR' as severity, 'DESIGN.RANK_DEFICIENT' as code, case when (select count(*) from supplier) > 99 then '26 of 30' else '' end as subject where (select count(*) from supplier) > 99")
def _(v):
    return X.validate_design(v.meta, DESIGN, "condition", "ASIA", "EUROPE").where("code = 'DESIGN.RANK_DEFICIENT'")


@query("de_design_cells", "m_meta", sql="select condition, batch, count(*) as sample_count from m_meta group by 1, 2")
def _(v):
    return X.design_cells(v.meta, ["condition", "covariate", "batch"])


def label_fit(v):
    enc = X.encode(v.embed_meta, X.Design(["label"]))
    return L.lm_fit(v.embed, enc, X.contrast_weights(enc, "label", "c1", "c0"))


FIT = """s as (select feature_id, label, count(*) as n, avg(value) as m, var_pop(value) * count(*) as ss from m_embed join e_meta using (sample_id) group by 1, 2),
 fit as (select feature_id, sum(n * m) / sum(n) as mean, max(m) filter (label = 'c1') - max(m) filter (label = 'c0') as effect, sqrt(sum(1.0 / n) filter (label in ('c0', 'c1'))) as stdev_unscaled, sum(ss) / (sum(n) - count(*)) as sigma2 from s group by 1)"""


@query("de_lm_fit", "m_embed", "e_meta", sql=f", {FIT} select feature_id, round(mean, 6) as mean, round(effect, 6) as effect, round(stdev_unscaled, 6) as stdev_unscaled, round(sigma2, 6) as sigma2 from fit")
def _(v):
    return show(label_fit(v)[0])


def label_de(v) -> DataFrame:
    fit, df = label_fit(v)
    return L.ebayes(fit, df, trend=True).select(
        "feature_id", "mean", F.col("effect").alias("log2_fold_change"), "standard_error", "statistic", "p_value")


@query("de_ebayes")
def _(v):
    return show(label_de(v))


def region_counts_design(v):
    enc = X.encode(v.meta, X.Design(["condition"]))
    return enc, X.contrast_weights(enc, "condition", "ASIA", "AFRICA")


@query("de_voom")
def _(v):
    enc, contrast = region_counts_design(v)
    factors = Q.tmm_factors(v.counts).select("sample_id", (F.col("library_size") * F.col("norm_factor")).alias("size"))
    return show(L.voom(v.counts, factors, enc, contrast).select("feature_id", "effect", "statistic", "p_value"))


def cohort_factors(v):
    """Library size over the mean library: `m_counts` has no feature in every sample."""
    library = v.counts.groupBy("sample_id").agg(F.sum("value").alias("_l"))
    return Q.one_row(library, library.agg(F.avg("_l").alias("_m"))).select("sample_id", (F.col("_l") / F.col("_m")).alias("size_factor"))


def nb_result(v):
    enc, contrast = region_counts_design(v)
    return N.nb_wald(v.counts, enc, cohort_factors(v), contrast)


@query("de_nb_wald")
def _(v):
    return show(nb_result(v).select("feature_id", "base_mean", "effect", "statistic", "p_value"))


@query("de_nb_shrink")
def _(v):
    enc, contrast = region_counts_design(v)
    return show(N.nb_wald(v.counts, enc, cohort_factors(v), contrast, shrink=True).select("feature_id", "base_mean", "effect", "standard_error", "p_value"))


PLANTED = 1_000_000


@query("de_nb_cooks", sql=f"""select cast(l_partkey as varchar) as feature_id, cast(min(l_suppkey) as varchar) as sample_id, {PLANTED}.0::double as value, true as replaced
 from lineitem where l_partkey % 97 = 0 group by l_partkey""")
def _(v):
    """A wild count in the first sample of every 97th feature: each is found, and replaced in a region of seven suppliers or more."""
    number, sample = F.col("feature_id").cast("bigint"), F.col("sample_id").cast("bigint")
    first = v.counts.where(number % 97 == 0).groupBy("feature_id").agg(F.min(sample).alias("_first"))
    wild = v.counts.join(first, "feature_id", "left").withColumn("value", F.when(sample == F.col("_first"), F.lit(float(PLANTED))).otherwise(F.col("value").cast("double"))).drop("_first")
    enc, _ = region_counts_design(v)
    found = N.count_outliers(wild, enc, cohort_factors(v)).where(F.col("value") >= PLANTED)
    return found.select("feature_id", "sample_id", "value", F.col("replacement").isNotNull().alias("replaced"))


@query("de_nb_qlf")
def _(v):
    enc, contrast = region_counts_design(v)
    libraries = v.counts.groupBy("sample_id").agg(F.sum("value").alias("size"))
    return show(N.nb_qlf(v.counts, enc, libraries, contrast).select("feature_id", "mean", "effect", "df_prior", "statistic", "p_value"))


# a result table with exact arithmetic, so the later steps have a counterpart in SQL
SIMPLE = """base as (select cast(l_partkey as varchar) as feature_id, avg(l_quantity) filter (l_returnflag = 'A') - avg(l_quantity) filter (l_returnflag = 'N') as log2_fold_change, avg(l_quantity) as base_expression,
 count(*) as n, sum(l_quantity) as q, min(l_shipdate) as d from lineitem group by 1),
 p as (select feature_id, p_brand as symbol, base_expression, log2_fold_change / 4 as log2_fold_change, case when n > 38 then null else round((q % 97 + 1) / 98 * (q % 11) / 10, 4) end as p_value from base join part on cast(p_partkey as varchar) = feature_id),
 r as (select *, rank() over (order by p_value nulls last) + count(*) over (partition by p_value) - 1 as k, count(p_value) over () as m from p),
 de as (select feature_id, symbol, base_expression, log2_fold_change, p_value, case when p_value is null then null else least(1, min(p_value * m / k) over (order by p_value desc nulls first rows between unbounded preceding and current row)) end as adj from r),
 dea as (select feature_id, symbol, base_expression, log2_fold_change, p_value, case when p_value is null then null else min(adj) over (partition by p_value) end as adjusted_p_value from de),
 des as (select *, coalesce(adjusted_p_value <= 0.2 and abs(log2_fold_change) >= 1, false) as significant from dea)"""


def simple_de(v) -> DataFrame:
    line, quantity = v.table("lineitem"), F.col("l_quantity")
    base = line.groupBy(F.col("l_partkey").cast("string").alias("feature_id")).agg(
        (F.avg(F.when(F.col("l_returnflag") == "A", quantity)) - F.avg(F.when(F.col("l_returnflag") == "N", quantity))).alias("_c"),
        F.avg(quantity).alias("base_expression"), F.count(F.lit(1)).alias("_n"), F.sum(quantity).alias("_q"))
    p = F.when(F.col("_n") <= 38, F.round((F.col("_q") % 97 + 1) / 98 * (F.col("_q") % 11) / 10, 4))
    return base.select("feature_id", "base_expression", (F.col("_c") / 4).alias("log2_fold_change"), p.alias("p_value"))


def simple_significant(v) -> DataFrame:
    return R.call_significant(L.bh_adjust(simple_de(v)), 0.2, 1.0)


@query("de_bh", sql=f"with {SIMPLE} select feature_id, round(p_value, 6) as p_value, round(adjusted_p_value, 6) as adjusted_p_value from des")
def _(v):
    return show(L.bh_adjust(simple_de(v)).select("feature_id", "p_value", "adjusted_p_value"))


@query("de_significant", sql=f"with {SIMPLE} select feature_id, round(log2_fold_change, 6) as log2_fold_change, round(adjusted_p_value, 6) as adjusted_p_value, significant from des")
def _(v):
    return show(simple_significant(v).orderBy(*R.result_order()).select("feature_id", "log2_fold_change", "adjusted_p_value", "significant"))


@query("de_annotate", sql=f"with {SIMPLE} select feature_id, coalesce(symbol, '') as gene_symbol, 'A versus N within flag' as contrast, 'limma' as method, significant from des")
def _(v):
    out = R.annotate_de(simple_significant(v), v.feat, "A versus N within flag", "limma")
    return out.select("feature_id", "gene_symbol", "contrast", "method", "significant")


@query("de_p_histogram", sql=f"""with {SIMPLE}, b as (select unnest(range(20)) as bin) select cast(bin as int) as bin, bin / 20 as start, (bin + 1) / 20 as "end", (select count(*) from des where p_value is not null and least(floor(p_value * 20), 19) = bin) as count,
 (select count(p_value) from des) as finite_p_value_count, (select count(*) - count(p_value) from des) as missing_p_value_count from b""")
def _(v):
    return R.p_histogram(simple_de(v))


HEAT = """top as (select feature_id, row_number() over (order by adjusted_p_value nulls last, abs(log2_fold_change) desc nulls last, feature_id) as feature_order from des qualify feature_order <= 30),
 ord as (select sample_id, row_number() over (order by batch, case condition when 'AFRICA' then 1 when 'ASIA' then 2 else 3 end, sample_id) as sample_order from m_meta),
 grid as (select t.feature_id, o.sample_id, feature_order, sample_order, coalesce(value, 0) as x from top t cross join ord o left join m_counts c on c.feature_id = t.feature_id and c.sample_id = o.sample_id)"""


@query("de_heatmap_block", "m_counts", "m_meta", sql=f", {SIMPLE}, {HEAT} select feature_id, sample_id, feature_order, sample_order, round((x - avg(x) over (partition by feature_id)) / stddev_samp(x) over (partition by feature_id), 6) as z from grid")
def _(v):
    return show(R.heatmap_block(simple_significant(v), v.counts, v.meta, "condition", "AFRICA", "ASIA", "batch"))


@query("de_effect_points", sql=f"""with {SIMPLE} select feature_id, round(log2_fold_change, 6) as volcano_x, case when p_value is not null then round(-log10(greatest(p_value, 2.2250738585072014e-308)), 6) + 0 end as volcano_y, round(base_expression, 6) as ma_x, round(log2_fold_change, 6) as ma_y, round(adjusted_p_value, 6) as adjusted_p_value, significant from des""")
def _(v):
    return show(R.effect_points(simple_significant(v), "base_expression"))


@query("de_result_page", sql=f"""with {SIMPLE}, f as (select * from des where (feature_id like '%7%' or lower(symbol) like '%7%') and adjusted_p_value <= 0.9 and abs(log2_fold_change) >= 0.5)
 select feature_id, symbol as gene_symbol, round(log2_fold_change, 6) as log2_fold_change, (select count(*) from f) as total from f order by f.log2_fold_change desc, feature_id limit 25 offset 10""")
def _(v):
    named = R.annotate_de(simple_significant(v), v.feat, "A versus N", "limma")
    page = R.result_page(named, "log2_fold_change", True, 10, 25, search=" 7 ", fdr_max=0.9, change_min=0.5)
    return show(page.select("feature_id", "gene_symbol", "log2_fold_change", "total"))


@query("de_feature_detail", "m_counts", "m_meta", sql="""select condition as level, count(*) as sample_count, round(avg(coalesce(value, 0)), 6) as mean, min(coalesce(value, 0)) as minimum, max(coalesce(value, 0)) as maximum, median(coalesce(value, 0)) as median, case condition when 'AFRICA' then 0 when 'ASIA' then 1 else 2 end as place
 from m_meta left join m_counts c on c.sample_id = m_meta.sample_id and feature_id = '17' group by 1""")
def _(v):
    return show(R.feature_detail(simple_significant(v), v.counts, v.meta, "17", "condition", "AFRICA", "ASIA")[2])


@query("de_independent_filter")
def _(v):
    de = simple_de(v).withColumnRenamed("base_expression", "base_mean")
    return show(N.independent_filter(de, 0.2).select("feature_id", "base_mean", "p_value", "adjusted_p_value"))


# ---- enrichment

RANKED = """rk as (select feature_id, sign(log2_fold_change) * -log10(greatest(p_value, 2.2250738585072014e-308)) + 0.0 as score from des where p_value is not null and log2_fold_change is not null),
 rp as (select *, row_number() over (order by score desc, feature_id) as position, count(*) over () as nf from rk)"""


@query("gse_rank", sql=f"with {SIMPLE}, {RANKED} select feature_id, round(score, 6) as score, position from rp")
def _(v):
    return show(E.rank_features(simple_significant(v)))


@query("gse_eligible", "m_sets", sql=f", {SIMPLE} select set_id, count(*) as set_size from (select distinct set_id, feature_id from m_sets where feature_id in (select feature_id from des)) group by 1 having count(*) between 320 and 340")
def _(v):
    return E.eligible_sets(v.sets, simple_de(v), 320, 340).groupBy("set_id").agg(F.count(F.lit(1)).alias("set_size"))


GSEA = """mem as (select set_id, feature_id, abs(score) as w, position, nf, count(*) over (partition by set_id) as k from m_sets join rp using (feature_id)),
 st as (select *, case when sum(w) over (partition by set_id) = 0 then 1.0 / k else w / sum(w) over (partition by set_id) end as step from mem),
 grid as (select s.set_id, r.position, r.feature_id, m.step, s.k, r.nf from (select distinct set_id, k from st) s cross join rp r left join st m on m.set_id = s.set_id and m.feature_id = r.feature_id),
 run as (select *, sum(coalesce(step, -1.0 / (nf - k))) over (partition by set_id order by position) as v from grid),
 ext as (select set_id, any_value(k) as set_size, max(v) as hi, min(v) as lo, arg_max(position, (round(v, 9), -position)) as hp, arg_min(position, (round(v, 9), position)) as lp from run group by 1)"""


@query("gse_score", "m_sets", sql=f", {SIMPLE}, {RANKED}, {GSEA} select set_id, set_size, round(case when abs(hi) >= abs(lo) then hi else lo end, 6) as enrichment_score, case when abs(hi) >= abs(lo) then 'up' else 'down' end as direction from ext")
def _(v):
    ranks = E.rank_features(simple_significant(v))
    return show(E.gsea_score(ranks, E.eligible_sets(v.sets, ranks, 1, 10**9))[0])


@query("gse_leading_edge", "m_sets", sql=f", {SIMPLE}, {RANKED}, {GSEA} select set_id, feature_id, st.position from st join ext using (set_id) where case when abs(hi) >= abs(lo) then st.position <= hp else st.position >= lp end")
def _(v):
    ranks = E.rank_features(simple_significant(v))
    return E.gsea_score(ranks, E.eligible_sets(v.sets, ranks, 1, 10**9))[1]


PERMUTED = f"""obs as (select set_id, set_size, case when abs(hi) >= abs(lo) then hi else lo end as es from ext),
 pm as (select feature_id, permutation, row_number() over (partition by permutation order by cast('0x' || substr(md5('11|' || permutation || '|' || feature_id), 1, 15) as bigint), feature_id) as position from rp, (select unnest(range(1, 61)) as permutation)),
 ph as (select st.set_id, pm.permutation, pm.position, st.k, st.nf, abs(w.score) as w from st join pm using (feature_id) join rp w on w.position = pm.position),
 ps as (select *, w / sum(w) over (partition by set_id, permutation) as step, row_number() over (partition by set_id, permutation order by position) as j, sum(w) over (partition by set_id, permutation order by position) / sum(w) over (partition by set_id, permutation) as c from ph),
 pr as (select set_id, permutation, max(c - (position - j) / (nf - k)) as h, min(c - step - (position - j) / (nf - k)) as l from ps group by 1, 2),
 nu as (select set_id, case when abs(h) >= abs(l) - 1e-12 then h else l end as ns from pr),
 pv as (select set_id, any_value(set_size) as set_size, any_value(es) as es, count(*) filter ((es >= 0) = (ns >= 0)) as same, count(*) filter (case when es >= 0 then ns >= 0 and ns >= es else ns < 0 and ns <= es end) as beyond, avg(abs(ns)) filter ((es >= 0) = (ns >= 0)) as sc from nu join obs using (set_id) group by 1)"""


@query("gse_permute", "m_sets", sql=f""", {SIMPLE}, {RANKED}, {GSEA}, {PERMUTED} select set_id, set_size, case when es >= 0 then 'up' else 'down' end as direction, round(es, 6) as enrichment_score,
 round(case when same > 0 and sc > 0 then es / sc else 0 end, 6) as normalized_enrichment_score, round((beyond + 1) / (same + 1), 6) as p_value from pv""")
def _(v):
    ranks = E.rank_features(simple_significant(v))
    return show(E.gsea_permute(ranks, E.eligible_sets(v.sets, ranks, 1, 10**9), 60, 11))


ORA = """u as (select count(*) as u, count(*) filter (significant) as f from des),
 o as (select set_id, count(*) as m, count(*) filter (significant) as a, avg(log2_fold_change) filter (significant) as mean, any_value(u) as u, any_value(f) as f from m_sets join des using (feature_id), u group by 1),
 tail as (select set_id, sum(exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(u - m + 1) - lgamma(f - x + 1) - lgamma(u - m - f + x + 1) - lgamma(u + 1) + lgamma(f + 1) + lgamma(u - f + 1))) as p
  from (select *, unnest(range(a, least(m, f) + 1)) as x from o) where u - m - f + x >= 0 group by 1)"""


@query("gse_ora", "m_sets", sql=f""", {SIMPLE}, {ORA} select set_id, case when mean > 0 then 'up' when mean < 0 then 'down' else 'mixed' end as direction, m as set_size, a as overlap_size,
 round((a + 0.5) * (u - a - (f - a) - (m - a) + 0.5) / ((f - a + 0.5) * (m - a + 0.5)), 6) as odds_ratio, round(least(p, 1), 6) as p_value from o join tail using (set_id)""")
def _(v):
    return show(E.ora(simple_significant(v), v.sets, 1, 10**9)[0])


@query("gse_finish", "m_sets", sql=f""", {SIMPLE}, {ORA}, x as (select set_id, least(p, 1) as p, (a + 0.5) * (u - a - (f - a) - (m - a) + 0.5) / ((f - a + 0.5) * (m - a + 0.5)) as e from o join tail using (set_id)),
 y as (select *, row_number() over (order by p) as k, count(*) over () as n from x), z as (select *, least(1, min(p * n / k) over (order by p desc rows between unbounded preceding and current row)) as adj from y)
 select set_id, round(adj, 6) as adjusted_p_value, adj <= 0.5 as significant, row_number() over (order by adj, -abs(e), set_id) as rank from z""")
def _(v):
    out = E.finish_enrichment(E.ora(simple_significant(v), v.sets, 1, 10**9)[0], "odds_ratio", 0.5)
    return show(out.select("set_id", "adjusted_p_value", "significant", "rank"))


@query("gse_overlap", "m_sets", sql=f", {SIMPLE} select set_id, feature_id from m_sets join des using (feature_id) where significant")
def _(v):
    return E.ora(simple_significant(v), v.sets, 1, 10**9)[1]


# ---- scoring

GRID = "ss as (select distinct sample_id from m_counts), mm as (select set_id, feature_id, weight from m_sets where feature_id in (select feature_id from m_counts)), sm as (select * from mm cross join ss)"


def members(v):
    """Set entries that the matrix has."""
    return v.sets.join(v.counts.select("feature_id").distinct(), "feature_id", "left_semi").select("set_id", "feature_id", "weight")


@query("sig_mean", "m_counts", "m_sets", sql=f", {GRID} select set_id, sample_id, round(sum(coalesce(value, 0)) / count(*), 6) as score from sm left join m_counts using (feature_id, sample_id) group by 1, 2")
def _(v):
    return show(S.score_mean(v.counts, members(v)))


@query("sig_weighted", "m_counts", "m_sets", sql=f", {GRID} select set_id, sample_id, round(sum(weight * coalesce(value, 0)), 6) as score from sm left join m_counts using (feature_id, sample_id) group by 1, 2")
def _(v):
    return show(S.score_weighted(v.counts, members(v)))


@query("sig_mean_z", "m_counts", "m_sets", sql=f""", {GRID}, c as (select set_id, sample_id, feature_id, coalesce(value, 0) as x from sm left join m_counts using (feature_id, sample_id)),
 z as (select *, avg(x) over (partition by set_id, feature_id) as m, stddev_samp(x) over (partition by set_id, feature_id) as s from c) select set_id, sample_id, round(avg((x - m) / s), 6) as score from z where s > 0 group by 1, 2""")
def _(v):
    return show(S.score_mean_z(v.counts, members(v)))


@query("sig_rank", "m_counts", "m_sets", sql=f""", {GRID}, ff as (select distinct feature_id from m_counts), d as (select ss.sample_id, ff.feature_id, coalesce(value, 0) as x from ss cross join ff left join m_counts c on c.sample_id = ss.sample_id and c.feature_id = ff.feature_id),
 k as (select *, (rank() over (partition by sample_id order by x) + (count(*) over (partition by sample_id, x) - 1) / 2.0) / count(*) over (partition by sample_id) as r from d)
 select set_id, sample_id, round(avg(r), 6) as score from mm join k using (feature_id) group by 1, 2""")
def _(v):
    return show(S.score_rank(v.counts, members(v)))


@query("sig_ssgsea", "m_embed", "e_sets", sql=""", r as (select *, cast(floor(rank() over (partition by sample_id order by value) + (count(*) over (partition by sample_id, value) - 1) / 2.0) as bigint) as rk, count(*) over (partition by sample_id) as n from m_embed),
 o as (select *, row_number() over (partition by sample_id order by rk desc, feature_id) as pos from r),
 h as (select set_id, sample_id, any_value(n) as n, count(*) as k, sum(pow(rk, 0.25) * (n - pos + 1)) as wa, sum(pow(rk, 0.25)) as w, sum(n - pos + 1) as a from o join e_sets using (feature_id) group by 1, 2),
 s as (select set_id, sample_id, wa / w - (n * (n + 1) / 2 - a) / (n - k) as s from h) select set_id, sample_id, round(s / (max(s) over () - min(s) over ()), 6) as score from s""")
def _(v):
    return show(S.score_ssgsea(v.embed, v.embed_sets))


@query("sig_gsva")
def _(v):
    return show(S.score_gsva(v.embed, v.embed_sets))


@query("sig_gsva_ecdf")
def _(v):
    return show(S.score_gsva(v.embed, v.embed_sets, kernel="none"))


@query("sig_summary", "m_counts", "m_sets", sql=f""", {GRID}, sc as (select set_id, sample_id, sum(coalesce(value, 0)) / count(*) as s from sm left join m_counts using (feature_id, sample_id) group by 1, 2),
 q as (select set_id, count(*) as requested_identifier_count, count(distinct feature_id) as unique_identifier_count from m_sets group by 1)
 select set_id, round(min(s), 6) as score_minimum, round(max(s), 6) as score_maximum, round(avg(s), 6) as score_mean, any_value(k) as mapped_identifier_count, any_value(k) as scored_feature_count, 0::bigint as excluded_constant_feature_count,
 any_value(requested_identifier_count) as requested_identifier_count, any_value(unique_identifier_count) as unique_identifier_count, round(any_value(k) / any_value(unique_identifier_count), 6) as mapping_coverage
 from sc join (select set_id, count(*) as k from mm group by 1) using (set_id) join q using (set_id) group by 1""")
def _(v):
    requested = v.sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("requested_identifier_count"), F.count_distinct("feature_id").alias("unique_identifier_count"))
    used = S.variable_members(v.counts, members(v))
    return show(S.score_summary(S.score_mean(v.counts, members(v)), used, requested))


@query("sig_associate", "m_counts", "m_sets", "m_meta", sql=f""", {GRID}, sc as (select set_id, sample_id, sum(coalesce(value, 0)) / count(*) as s from sm left join m_counts using (feature_id, sample_id) group by 1, 2)
 select set_id, 'adjusted_linear_regression' as test, round(regr_slope(s, covariate), 9) as effect, round(corr(s, covariate) * sqrt((count(*) - 2) / (1 - corr(s, covariate) ** 2)), 6) as statistic, round(corr(s, covariate), 6) as correlation,
 cast(count(*) as int) as sample_count, cast(count(*) - 2 as int) as degrees_of_freedom from sc join m_meta using (sample_id) group by 1""")
def _(v):
    out = A.associate(S.score_mean(v.counts, members(v)), v.meta, "covariate")
    return out.select("set_id", "test", rounded(F.col("effect"), 9).alias("effect"), rounded(F.col("statistic")).alias("statistic"),
                      rounded(F.col("correlation")).alias("correlation"), "sample_count", "degrees_of_freedom")


@query("sig_associate_groups", "m_counts", "m_sets", "m_meta", sql=f""", {GRID}, sc as (select set_id, sample_id, condition, sum(coalesce(value, 0)) / count(*) as s from sm left join m_counts using (feature_id, sample_id) join m_meta using (sample_id) group by 1, 2, 3),
 a as (select set_id, condition, count(*) as n, avg(s) as m, var_pop(s) * count(*) as ss from sc group by 1, 2), b as (select set_id, sum(n * m) / sum(n) as g from a group by 1)
 select set_id, 'adjusted_omnibus_group_comparison' as test, round(sum(n * (m - g) * (m - g)) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))), 6) as statistic, cast(sum(n) as int) as sample_count, cast(sum(n) - count(*) as int) as degrees_of_freedom from a join b using (set_id) group by 1""")
def _(v):
    out = A.associate(S.score_mean(v.counts, members(v)), v.meta, "condition")
    return show(out.select("set_id", "test", "statistic", "sample_count", "degrees_of_freedom"))


@query("sig_associate_adjusted")
def _(v):
    return show(A.associate(S.score_mean_z(v.counts, members(v)), v.meta, "condition", covariates=["covariate"]))


@query("sig_group_means", "m_counts", "m_sets", "m_meta", sql=f""", {GRID}, sc as (select set_id, sample_id, sum(coalesce(value, 0)) / count(*) as s from sm left join m_counts using (feature_id, sample_id) group by 1, 2)
 select set_id, condition as level, count(*) as sample_count, round(avg(s), 6) as score_mean from sc join m_meta using (sample_id) group by 1, 2""")
def _(v):
    return show(A.group_means(S.score_mean(v.counts, members(v)), v.meta, "condition"))


@query("sig_check_association", "m_meta", sql="select 'ERROR' as severity, 'ASSOCIATION.RANK_DEFICIENT' as code, (25 || ' of ' || 29) as subject where (select count(distinct batch) from m_meta) = 25 union all select 'ERROR', 'ASSOCIATION.GROUP_TOO_SMALL', batch from m_meta group by batch having count(*) < 2")
def _(v):
    a = X.check_association(v.meta, "condition", [], "batch").where("code <> 'ASSOCIATION.NO_RESIDUAL_DF'")
    return a.unionByName(X.check_association(v.meta, "batch", []).where("code = 'ASSOCIATION.GROUP_TOO_SMALL'"))


# ---- composition

def marker_table(v):
    return v.sets.select(F.col("set_id").alias("cell_type_id"), F.col("feature_id").alias("gene"))


@query("dec_marker_mean", "m_counts", "m_sets", sql=f", {GRID} select set_id as cell_type_id, sample_id, round(sum(coalesce(value, 0)) / count(*), 6) as value from sm left join m_counts using (feature_id, sample_id) group by 1, 2")
def _(v):
    return show(D.decon_markers(v.counts, marker_table(v)))


@query("dec_fractions")
def _(v):
    signature = v.region_counts.select(F.col("feature_id").alias("gene"), F.col("sample_id").alias("cell_type_id"), "value")
    return show(D.decon_fractions(v.nation_counts, signature))


def _named(v):
    return v.estimates.withColumnRenamed("population", "cell_type_id")


@query("dec_composition", "d_estimates", sql="select run || '-' || sample_id as sample_id, round(sum(value), 6) as reported_sum, round(greatest(0, 1 - sum(value)), 6) as residual_fraction, abs(sum(value) - 1) <= 1e-6 as within_tolerance from d_estimates group by 1")
def _(v):
    return show(D.composition(_named(v).withColumn("sample_id", F.concat_ws("-", "run", "sample_id"))))


@query("dec_population_z", "d_estimates", sql="select sample_id, run || population as cell_type_id, round((value - avg(value) over (partition by run, population)) / stddev_samp(value) over (partition by run, population), 5) as z from d_estimates")
def _(v):
    rows = v.estimates.select("sample_id", F.concat("run", "population").alias("cell_type_id"), "value")
    return show(D.population_z(rows), digits=5)


@query("dec_check_estimates", "m_counts", sql="""with_absent as (select a.sample_id, b.cell_type_id from (select distinct sample_id from m_counts) a cross join (select distinct p_type as cell_type_id from part) b) select 'ABSENT' as code, sample_id, cell_type_id from with_absent
 where (sample_id, cell_type_id) not in (select cast(l_suppkey as varchar), p_type from lineitem join part on l_partkey = p_partkey where l_discount = 0.1 and l_tax = 0.08)
 union all select 'DUPLICATE', cast(l_suppkey as varchar), p_type from lineitem join part on l_partkey = p_partkey where l_discount = 0.1 and l_tax = 0.08 group by 2, 3 having count(*) > 1""".replace("with_absent as", ", with_absent as", 1))
def _(v):
    line = v.table("lineitem").where("l_discount = 0.1 and l_tax = 0.08").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = line.select(F.col("l_suppkey").cast("string").alias("sample_id"), F.col("p_type").alias("cell_type_id"), F.col("l_quantity").alias("value"))
    return D.check_estimates(rows, v.counts.select("sample_id").distinct(), v.table("part").select(F.col("p_type").alias("cell_type_id")).distinct())


@query("dec_compare_runs", "d_estimates", sql="""select a.run as left_run, b.run as right_run, population as cell_type_id, count(*) as sample_count, round(corr(a.value, b.value), 6) as pearson_correlation from d_estimates a join d_estimates b using (sample_id, population)
 where a.run < b.run group by 1, 2, 3 having stddev_pop(a.value) > 0 and stddev_pop(b.value) > 0""")
def _(v):
    runs = v.estimates.select("run").distinct().select(
        "run", F.concat(F.lit("method "), "run").alias("method"), F.lit("cell_fraction").alias("result_type"), F.lit("fraction").alias("unit"), F.lit("tpm").alias("assay"), F.lit("b").alias("bundle"))
    return show(D.compare_runs(runs, _named(v)))
