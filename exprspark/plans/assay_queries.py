"""Classifier metrics and validation, assay experiments and studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprspark.operators import classifier as C
from exprspark.operators import experiments as E
from exprspark.operators import factorial as Y
from exprspark.operators import metrics as M
from exprspark.operators import predict as P
from exprspark.operators import studies as U
from exprspark.operators.validate import profile_variables
from exprspark.plans.cohort_queries import show
from exprspark.plans.registry import query
from exprspark.session import cut


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def binary(v) -> DataFrame:
    return v.binary.withColumn("predicted", F.col("p") >= 0.5)


def metric_sql(by: str = "", source: str = "b", weight: str = "1") -> str:
    """All binary metrics of `source` (y, p, predicted) per key."""
    keys = f"{by}," if by else ""
    part = f"partition by {by}" if by else ""
    using = f"join mc using ({by})" if by else ", mc"
    group = f"group by {by}" if by else ""
    return f"""mt as (select {keys} p, sum(case when y = 1 then {weight} else 0 end) as pos, sum(case when y = 1 then 0 else {weight} end) as neg from {source} group by {keys} p),
 mr as (select *, sum(pos) over ({part} order by p desc) as tp, sum(neg) over ({part} order by p desc) as fp, sum(pos) over ({part}) as np, sum(neg) over ({part}) as nn from mt),
 ma as (select {keys} sum(pos * (nn - fp + neg / 2)) / (max(np) * max(nn)) as roc_auc, sum(pos / np * tp / (tp + fp)) as pr_auc from mr {group}),
 mc as (select {keys} sum(case when y = 1 and predicted then {weight} else 0 end)::bigint as true_positive, sum(case when y = 0 and predicted then {weight} else 0 end)::bigint as false_positive,
  sum(case when y = 0 and not predicted then {weight} else 0 end)::bigint as true_negative, sum(case when y = 1 and not predicted then {weight} else 0 end)::bigint as false_negative, sum({weight} * (p - y) * (p - y)) / sum({weight}) as brier_score from {source} {group}),
 mm as (select {keys} roc_auc, pr_auc, (true_positive / greatest(true_positive + false_negative, 1) + true_negative / greatest(true_negative + false_positive, 1)) / 2 as balanced_accuracy,
  (true_positive + true_negative) / (true_positive + true_negative + false_positive + false_negative) as accuracy, true_positive / greatest(true_positive + false_negative, 1) as sensitivity,
  true_negative / greatest(true_negative + false_positive, 1) as specificity, true_positive / greatest(true_positive + false_positive, 1) as "precision", 2 * true_positive / greatest(2 * true_positive + false_positive + false_negative, 1) as f1,
  coalesce((true_positive::double * true_negative - false_positive::double * false_negative) / nullif(sqrt((true_positive + false_positive)::double * (true_positive + false_negative) * (true_negative + false_positive) * (true_negative + false_negative)), 0), 0) as mcc,
  brier_score, true_positive, false_positive, true_negative, false_negative, (true_positive + false_negative) / (true_positive + true_negative + false_positive + false_negative) as prevalence from ma {using})"""


NAMES = ["roc_auc", "pr_auc", "balanced_accuracy", "accuracy", "sensitivity", "specificity", "precision", "f1", "mcc", "brier_score", "prevalence"]
ROUNDED = ", ".join(f'round("{n}", 6) as "{n}"' for n in NAMES) + ", true_positive, false_positive, true_negative, false_negative"
PB = "b as (select *, p >= 0.5 as predicted from p_binary)"


@query("clf_binary_metrics", "p_binary", sql=f", {PB}, {metric_sql()} select {ROUNDED} from mm")
def _(v):
    return show(M.binary_metrics(binary(v)))


@query("clf_metrics_by_cohort", "p_binary", sql=f", {PB}, {metric_sql('cohort')} select cohort, {ROUNDED} from mm")
def _(v):
    return show(M.binary_metrics(binary(v), ["cohort"]), "cohort")


@query("clf_youden", "p_binary", sql=f""", {PB}, c as (select distinct p as t from b union select unnest([0.0, 0.5, 1.0])),
 j as (select t, count(*) filter (y = 1 and p >= t) / count(*) filter (y = 1) + count(*) filter (y = 0 and p < t) / count(*) filter (y = 0) - 1 as j from c cross join b group by 1)
 select round(t, 6) as threshold, round(j, 6) as youden from j order by round(j, 12) desc, abs(t - 0.5), t desc limit 1""")
def _(v):
    return show(M.youden(binary(v)))


CURVE = ", b as (select * from p_binary), t as (select p, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from b group by 1), c as (select *, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp, sum(pos) over () as np, sum(neg) over () as nn, row_number() over (order by p desc) as rn, lead(pos) over (order by p desc) as lp, lead(neg) over (order by p desc) as ln_ from t)"


@query("clf_roc_points", "p_binary", sql=f"{CURVE} select round(fp / nn, 6) as false_positive_rate, round(tp / np, 6) as true_positive_rate, round(p, 6) as threshold from c where rn = 1 or lp is null or lp <> pos or ln_ <> neg union all select 0, 0, null")
def _(v):
    return show(M.roc_points(binary(v)))


@query("clf_pr_points", "p_binary", sql=f"""{CURVE} select round(tp / np, 6) as recall, round(tp / (tp + fp), 6) as "precision", round(p, 6) as threshold from c union all select 0, 1, null""")
def _(v):
    return show(M.precision_recall_points(binary(v)))


@query("clf_calibration", "p_binary", sql="""select cast(least(len(list_filter([0.0, 0.1, 0.2, 3 * 0.1::double, 0.4, 0.5, 6 * 0.1::double, 7 * 0.1::double, 0.8, 0.9, 1.0], lambda x: x <= p)), 10) as int) as bin, round(avg(p), 6) as predicted_probability, round(avg(y), 6) as observed_fraction, count(*) as sample_count from p_binary group by 1""")
def _(v):
    return show(M.calibration_bins(binary(v)))


@query("clf_calibration_line")
def _(v):
    intercept, slope = M.calibration_line(binary(v))
    return v.binary.agg(F.count(F.lit(1)).alias("samples")).withColumn("intercept", F.lit(round(intercept, 6))).withColumn("slope", F.lit(round(slope, 6)))


THREE = """w as (select cast(vec_id as varchar) as sample_id, 'c' || cast(label // 4 as varchar) as observed, unnest(['c0', 'c1', 'c2']) as class, unnest([list_sum([abs(embedding[i]::double) for i in range(c, len(embedding) + 1, 3)]) for c in [1, 2, 3]]) as a from embeddings),
 long as (select sample_id, observed, class, a / sum(a) over (partition by sample_id) as probability from w),
 pred as (select sample_id, any_value(observed) as observed, arg_min(class, (-probability, class)) as predicted, max(probability) filter (class = observed) as q from long group by 1)"""


def three_classes(v) -> DataFrame:
    e = v.table("embeddings")
    third = "aggregate(filter(embedding, (x, i) -> i % 3 = {}), 0D, (s, x) -> s + abs(cast(x as double)))"
    a = F.array(*[F.expr(third.format(c)) for c in range(3)])
    rows = e.select(F.col("vec_id").cast("string").alias("sample_id"), F.concat(F.lit("c"), F.floor(F.col("label") / 4).cast("string")).alias("observed"),
                    a.alias("a"), F.aggregate(a, F.lit(0.0), lambda x, y: x + y).alias("t"))
    return rows.select("sample_id", "observed", F.posexplode("a").alias("i", "a"), "t").select(
        "sample_id", "observed", F.concat(F.lit("c"), F.col("i").cast("string")).alias("class"), (F.col("a") / F.col("t")).alias("probability"))


MULTI = """auc as (select class, (sum(r) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2) / (count(*) filter (y) * count(*) filter (not y)) as auc from
  (select class, observed = class as y, rank() over (partition by class order by probability) + (count(*) over (partition by class, probability) - 1) / 2.0 as r from long) group by 1),
 cls as (select c, count(*) filter (observed = c) as actual, count(*) filter (predicted = c) as called, count(*) filter (observed = c and predicted = c) as hit from pred, (select distinct class as c from long) group by 1)
 select (select round(avg(auc), 6) from auc) as macro_roc_auc, round(avg(2 * hit / (actual + called)), 6) as macro_f1, round(avg(hit / actual), 6) as balanced_accuracy, round(sum(hit) / sum(actual), 6) as accuracy, (select round(-avg(ln(q)), 6) from pred) as log_loss from cls"""


@query("clf_multiclass_metrics", sql=f"with {THREE}, {MULTI}")
def _(v):
    return show(M.multiclass_metrics(three_classes(v)))


@query("clf_class_confusion", sql=f"with {THREE} select observed, predicted, count(*) as n from pred group by 1, 2")
def _(v):
    return M.class_confusion(three_classes(v))


def md5_number(text: str, digits: int) -> str:
    return f"cast('0x' || substr(md5({text}), 1, {digits}) as bigint)"


BOOT = f"""{PB}, gi as (select g, row_number() over (order by {md5_number('g', 15)}, g) - 1 as slot, count(*) over () as ng from (select distinct "group" as g from b)),
 rep as (select unnest(range(60)) as replicate), dr as (select replicate, {md5_number("'5|' || replicate || '|' || slot", 8)} % ng as slot from gi, rep),
 wt as (select replicate, g, count(*) as weight from dr join gi using (slot) group by 1, 2), bb as (select replicate, y, p, predicted, weight from b join wt on g = "group")"""


@query("clf_bootstrap_ci", "p_binary", sql=f""", {BOOT}, {metric_sql('replicate', 'bb', 'weight')}, lg as (unpivot (select replicate, roc_auc, pr_auc, balanced_accuracy, brier_score from mm) on roc_auc, pr_auc, balanced_accuracy, brier_score into name metric value v)
 select metric, round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper from lg group by 1""")
def _(v):
    return show(M.bootstrap_ci(binary(v), 60, 5))


STRATA = f"""{PB}, ix as (select *, row_number() over (partition by y order by {md5_number('sample_id', 15)}, sample_id) - 1 as slot, count(*) over (partition by y) as ny from b),
 rep as (select unnest(range(40)) as replicate), dr as (select replicate, y, {md5_number("'9|' || y || '|' || replicate || '|' || slot", 8)} % ny as slot from ix, rep),
 wt as (select replicate, y, slot, count(*) as weight from dr group by all), bb as (select replicate, y, p, predicted, weight from ix join wt using (y, slot))"""


@query("clf_bootstrap_stratified", "p_binary", sql=f""", {STRATA}, {metric_sql('replicate', 'bb', 'weight')}, lg as (unpivot (select replicate, roc_auc, pr_auc, balanced_accuracy, sensitivity, specificity, brier_score from mm) on roc_auc, pr_auc, balanced_accuracy, sensitivity, specificity, brier_score into name metric value v)
 select metric, round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper from lg group by 1""")
def _(v):
    return show(M.bootstrap_stratified(binary(v), 40, 9))


@query("clf_bootstrap_multiclass")
def _(v):
    long = three_classes(v).withColumn("group", F.substring("sample_id", -1, 1))
    return show(M.bootstrap_ci_multiclass(long, 40, 3))


# ---- folds and audits

LABELS = "lb as (select sample_id, \"group\" as g, y from p_binary), un as (select g as unit, arg_min(cast(y as varchar), (-n, cast(y as varchar))) as stratum from (select g, y, count(*) as n from lb group by 1, 2) group by 1)"
FOLDS = f"""{LABELS}, de as (select unit, stratum, unnest([1, 2]) as repeat from un), nb as (select *, row_number() over (partition by repeat, stratum order by {md5_number("'3|' || repeat || '|' || unit", 15)}, unit) as rn from de),
 fd as (select repeat, unit, cast((rn - 1 + {md5_number("'3|' || repeat || '|' || stratum", 8)}) % 4 + 1 as int) as fold from nb), asg as (select repeat, sample_id, g, y, fold from lb join fd on g = unit)"""


def document_labels(v) -> DataFrame:
    return v.binary.select("sample_id", "y", "group")


@query("clf_assign_folds", "p_binary", sql=f", {FOLDS} select repeat, sample_id, fold from asg")
def _(v):
    return C.assign_folds(document_labels(v), 4, 2, 3).select("repeat", "sample_id", "fold")


@query("clf_fold_plan", "p_binary", sql=f""", {FOLDS}, t as (select repeat, count(*) as n, count(distinct g) as k from asg group by 1) select repeat, fold, any_value(n) - count(*) as training_sample_count, count(*) as test_sample_count, count(distinct y) as test_class_count,
 any_value(k) - count(distinct g) as training_group_count, count(distinct g) as test_group_count, 0::bigint as group_overlap_count from asg join t using (repeat) group by 1, 2""")
def _(v):
    return C.fold_plan(C.assign_folds(document_labels(v), 4, 2, 3))


@query("clf_fold_classes", "p_binary", sql=f", {FOLDS} select repeat, fold, y, count(*) as n from asg group by all")
def _(v):
    return C.class_counts(C.assign_folds(document_labels(v), 4, 2, 3))


@query("clf_leakage", "p_binary", sql="""select 1 as repeat, "group" as unit, count(distinct cohort) as folds from p_binary group by 2 having count(distinct cohort) > 1""")
def _(v):
    """A split by language leaks sources: the check must name them."""
    leaky = v.binary.select(F.lit(1).alias("repeat"), "sample_id", "group", F.col("cohort").alias("fold"))
    return C.check_leakage(leaky)


@query("clf_oof_check", "p_binary", sql="""with_missing as (select sample_id, unnest([1, 2]) as repeat from p_binary) select sample_id, repeat, case when cohort = 'de' and repeat = 2 then 0 else 2 end as n from with_missing join p_binary using (sample_id) where (cohort = 'de' and repeat = 2) or (cohort = 'fr' and repeat = 1)""".replace("with_missing as", ", with_missing as", 1))
def _(v):
    labels = v.binary.select("sample_id", "cohort")
    seen = labels.withColumn("repeat", F.explode(F.array(F.lit(1), F.lit(2)))).where("not (cohort = 'de' and repeat = 2)")
    twice = seen.where("cohort = 'fr' and repeat = 1")
    return C.check_oof(seen.unionByName(twice), labels, 2).withColumn("n", F.col("n").cast("int"))


@query("clf_audit", "p_binary", sql="""select 'WARNING' as severity, 'CLASSIFIER.SEVERE_IMBALANCE' as code, '' as subject from (select y, count(*) as n from p_binary group by 1) having min(n) / max(n) < 0.25
 union all select 'ERROR', 'CLASSIFIER.TOO_FEW_GROUPS', '' from p_binary having count(distinct "group") < 21 union all select 'ERROR', 'CLASSIFIER.UNITS_PER_CLASS', cast(y as varchar) from p_binary group by y having count(distinct "group") < 21""")
def _(v):
    return C.audit_classifier(v.binary, "y", 21, "group", "1")


@query("clf_hidden_units", "p_binary", sql="""select 'Patient-ID' as variable, count(distinct "group") as unique_count from p_binary""")
def _(v):
    meta = v.binary.select("sample_id", F.col("group").alias("Patient-ID"), "cohort")
    return C.hidden_units(profile_variables(meta), meta.count()).select("variable", "unique_count")


@query("clf_permuted_labels", "p_binary", sql=f""", o as (select *, row_number() over (partition by "group" order by sample_id) as at_, row_number() over (partition by "group" order by {md5_number("'7|2|' || sample_id", 15)}, sample_id) as dr from p_binary)
 select a.sample_id, a."group", b.y from o a join o b on a."group" = b."group" and a.at_ = b.dr""")
def _(v):
    return C.permute_labels(document_labels(v), 7, 2)


# ---- fitted classifiers on the embedding matrix

#: All features, five outer and four inner folds, nine candidates.
WHOLE = C.Config(features=64, repeats=1, seed=4)


def embed_labels(v) -> DataFrame:
    label = F.substring("label", 2, 2).cast("int")
    return v.embed_meta.select("sample_id", (label >= 5).cast("int").alias("y"), F.lit(None).cast("string").alias("group"))


def embed_classes(v) -> DataFrame:
    group = F.floor(F.substring("label", 2, 2).cast("int") / 4)
    return v.embed_meta.select("sample_id", F.concat(F.lit("k"), group.cast("string")).alias("y"), F.lit(None).cast("string").alias("group"))


@query("clf_fit_enet")
def _(v):
    rows = C._rows(embed_labels(v))
    prepared = C.prepare_fold(v.embed, rows, rows, 64)
    model = C.fit_enet(prepared, 0.5, 0.5)
    return show(C._coefficients(model, prepared))


@query("clf_nested_cv")
def _(v):
    return show(C.nested_cv(v.embed, embed_labels(v), C.replace(WHOLE, repeats=3)).predictions)


@query("clf_stability")
def _(v):
    return show(C.stability(C.nested_cv(v.embed, embed_labels(v), C.replace(WHOLE, repeats=3)).coefficients, 15))


@query("clf_tune")
def _(v):
    (c, ratio), decisions = C.tune(v.embed, embed_labels(v), WHOLE, 4)
    line = C.fit_calibrator(decisions)
    return decisions.agg(F.count(F.lit(1)).alias("samples")).withColumn("c", F.lit(c)).withColumn("l1_ratio", F.lit(ratio)).withColumn(
        "calibration_slope", F.lit(round(line[1], 6)))


@query("clf_permutation_control")
def _(v):
    return show(C.permutation_control(v.embed, embed_labels(v), WHOLE, 100))


@query("clf_learning_curve")
def _(v):
    return show(C.learning_curve(v.embed, embed_labels(v), C.nested_cv(v.embed, embed_labels(v), WHOLE), WHOLE))


@query("clf_compare_models")
def _(v):
    return show(C.compare_models(v.embed, embed_labels(v), WHOLE), "method")


@query("clf_multiclass_cv")
def _(v):
    return show(C.nested_cv_multiclass(v.embed, embed_classes(v), WHOLE)[0])


@query("clf_permutation_multiclass")
def _(v):
    return show(C.permutation_control_multiclass(v.embed, embed_classes(v), WHOLE, 100))


@query("clf_lock_multiclass")
def _(v):
    locked = C.lock_model_multiclass(v.embed, embed_classes(v), WHOLE)
    return show(P.predict_locked(v.embed, locked.coefficients, locked.model))


@query("clf_lock_model")
def _(v):
    locked = C.lock_model(v.embed, embed_labels(v), WHOLE)
    return show(P.predict_locked(v.embed, locked.coefficients, locked.model))


# ---- locked prediction

COEF = """cf as (select feature_id, avg(value) as mean, stddev_pop(value) as scale, (cast(substr(feature_id, 2, 3) as int) - 31.5) / 40 as b1, ((cast(substr(feature_id, 2, 3) as int) * 5) % 7 - 3) / 10.0 as b2, ((cast(substr(feature_id, 2, 3) as int) * 3) % 5 - 2) / 10.0 as b3 from m_embed group by 1)"""


def coefficients(v) -> DataFrame:
    position = F.substring("feature_id", 2, 3).cast("int")
    return v.embed.groupBy("feature_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale")).select(
        "*", ((position - 31.5) / 40).alias("b1"), (((position * 5) % 7 - 3) / 10.0).alias("b2"), (((position * 3) % 5 - 2) / 10.0).alias("b3"))


MODEL = "class_count int, classes array<string>, intercepts array<double>, calibration string, calibration_slope double, calibration_intercept double, threshold double"


def binary_prediction(v) -> DataFrame:
    coef = coefficients(v).select("feature_id", "mean", "scale", F.lit("yes").alias("class"), F.col("b1").alias("coefficient"))
    model = v.spark.createDataFrame([(2, ["no", "yes"], [0.1], "sigmoid", 1.5, -0.2, 0.45)], MODEL)
    return P.predict_locked(v.embed, coef, model)


BIN = f"""{COEF}, dc as (select sample_id, sum((value - mean) / scale * b1) + 0.1 as d from m_embed join cf using (feature_id) group by 1), pr as (select sample_id, 1 / (1 + exp(-(d * 1.5 - 0.2))) as p from dc)"""


@query("clf_predict_locked", "m_embed", sql=f", {BIN} select sample_id, round(p, 6) as positive_probability, p >= 0.45 as predicted_positive, case when p >= 0.45 then 'yes' else 'no' end as predicted_class from pr")
def _(v):
    return show(binary_prediction(v))


@query("clf_predict_multiclass", "m_embed", sql=f""", {COEF}, d as (select sample_id, sum((value - mean) / scale * b1) + 0.1 as a, sum((value - mean) / scale * b2) - 0.2 as b, sum((value - mean) / scale * b3) as c from m_embed join cf using (feature_id) group by 1),
 l as (select sample_id, unnest(['a', 'b', 'c']) as class, unnest([a, b, c]) as d, greatest(a, b, c) as m from d), s as (select *, exp(d - m) / sum(exp(d - m)) over (partition by sample_id) as p from l)
 select sample_id, class, round(p, 6) as probability, arg_min(class, (-d, class)) over (partition by sample_id) as predicted_class from s""")
def _(v):
    wide = coefficients(v)
    coef = wide.select("feature_id", "mean", "scale", F.explode(F.map_from_arrays(
        F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array("b1", "b2", "b3"))).alias("class", "coefficient"))
    model = v.spark.createDataFrame([(3, ["a", "b", "c"], [0.1, -0.2, 0.0], "none", None, None, 0.5)], MODEL)
    return show(P.predict_locked(v.embed, coef, model))


@query("clf_feature_overlap", "m_counts", sql="""select count(*) as required_feature_count, count(*) filter (f in (select feature_id from m_counts)) as matched_feature_count, count(*) filter (f not in (select feature_id from m_counts)) as missing_feature_count,
 round(count(*) filter (f in (select feature_id from m_counts)) / count(*), 6) as overlap_fraction from (select cast(o_orderkey as varchar) as f from orders)""")
def _(v):
    needed = v.table("orders").select(F.col("o_orderkey").cast("string").alias("feature_id"))
    return show(P.feature_overlap(needed, v.counts))


@query("clf_truth_mismatch", "p_binary", sql="select case when sample_id in (select cast(doc_id as varchar) from documents where lang = 'en') then 'NOT_PREDICTED' else 'NO_TRUTH' end as code, sample_id from (select cast(doc_id as varchar) as sample_id from documents where lang = 'en' except select sample_id from p_binary union all (select sample_id from p_binary except select cast(doc_id as varchar) from documents where lang = 'en'))")
def _(v):
    truth = v.table("documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("sample_id"))
    return P.truth_mismatch(v.binary, truth)


@query("clf_evaluate_external", "p_binary", sql=f""", {STRATA.replace("b as (select *, p >= 0.5 as predicted from p_binary)", "b as (select *, p >= 0.4 as predicted from p_binary)")}, {metric_sql('replicate', 'bb', 'weight')}, lo as (select quantile_cont(roc_auc, 0.025) as lower from mm),
 t as (select (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as auc, count(*) filter (y = 1 and p >= 0.4) as tp from (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from p_binary))
 select round(auc, 6) as roc_auc, round(lower, 6) as roc_auc_lower, tp as true_positive, auc >= 0.5 as point_estimate_passed, lower > 0.5 as lower_bound_passed from t, lo""")
def _(v):
    predictions = v.binary.select("sample_id", F.col("p").alias("positive_probability"), (F.col("p") >= 0.4).alias("predicted_positive"),
                                  F.when(F.col("p") >= 0.4, "good").otherwise("bad").alias("predicted_class"))
    truth = v.binary.select("sample_id", F.when(F.col("y") == 1, "good").otherwise("bad").alias("response"))
    out, _ = P.evaluate_external(predictions, truth, "bad", "good", 0.4, 0.5, 0.5, 40, 9)
    return show(out.select("roc_auc", "roc_auc_lower", "true_positive", "point_estimate_passed", "lower_bound_passed"))


# ---- scores between groups

SCORED = "sc as (select p_type as set_id, r_name as level, l_suppkey as sample_id, avg(l_quantity) as score from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3)"
AUC = """rk as (select {k}, level, score, rank() over (partition by {k} order by score) + (count(*) over (partition by {k}, score) - 1) / 2.0 as r from sc),
 au as (select {k}, (sum(r) filter (level = '{n}') - count(*) filter (level = '{n}') * (count(*) filter (level = '{n}') + 1) / 2) / (count(*) filter (level = '{n}') * count(*) filter (level <> '{n}')) as auc,
  (count(*) filter (level = '{n}') * count(*) filter (level <> '{n}') - (sum(r) filter (level = '{n}') - count(*) filter (level = '{n}') * (count(*) filter (level = '{n}') + 1) / 2)) / (count(*) filter (level = '{n}') * count(*) filter (level <> '{n}')) as nauc from rk group by 1)"""


def set_scores(v) -> DataFrame:
    line = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    per = line.groupBy(F.col("p_type").alias("set_id"), F.col("l_suppkey").cast("string").alias("sample_id")).agg(F.avg("l_quantity").alias("score"))
    return per.join(v.meta.select("sample_id", F.col("condition").alias("level")), "sample_id")


@query("sig_directional_auc", sql=f"with {SCORED}, {AUC.format(k='set_id', n='ASIA')} select set_id, round(auc, 6) as auc from au")
def _(v):
    return show(M.directional_auc(set_scores(v), ["set_id"], "ASIA"))


@query("sig_benchmark", sql=f"""with {SCORED}, {AUC.format(k='set_id', n='ASIA')}, ef as (select set_id, avg(score) filter (level = 'ASIA') - avg(score) filter (level <> 'ASIA') as effect from sc group by 1),
 j as (select 'mean' as method, set_id, effect, auc, effect > 0 and auc >= 0.5 as passed from ef join au using (set_id) union all select 'negated', set_id, -effect, nauc, -effect > 0 and nauc >= 0.5 from ef join au using (set_id)),
 m as (select method, bool_and(passed) as method_passed from j group by 1)
 select method, set_id, round(effect, 6) as effect, round(auc, 6) as auc, passed, method_passed, (select method from m where method_passed order by method desc limit 1) as selected_method from j join m using (method)""")
def _(v):
    base = set_scores(v)
    both = union(base.withColumn("method", F.lit("mean")), base.withColumn("method", F.lit("negated")).withColumn("score", -F.col("score")))
    return show(M.benchmark_scores(both, "ASIA", "positive", 0.5, 2, ["negated", "mean"]))


COHORTS = f"""{SCORED.replace("p_type as set_id", "l_returnflag as cohort").replace("join part on l_partkey = p_partkey ", "")}, {AUC.format(k='cohort', n='EUROPE')},
 st as (select cohort, count(*) filter (level = 'EUROPE') as n1, count(*) filter (level <> 'EUROPE') as n0, avg(score) filter (level = 'EUROPE') - avg(score) filter (level <> 'EUROPE') as effect, var_samp(score) filter (level = 'EUROPE') as v1, var_samp(score) filter (level <> 'EUROPE') as v0, min(score) as lo, max(score) as hi from sc group by 1)"""


def cohort_scores(v) -> DataFrame:
    per = v.table("lineitem").groupBy(F.col("l_returnflag").alias("cohort"), F.col("l_suppkey").cast("string").alias("sample_id")).agg(F.avg("l_quantity").alias("score"))
    return per.join(v.meta.select("sample_id", F.col("condition").alias("level")), "sample_id")


@query("sig_concordance", sql=f"with {COHORTS} select cohort, round(effect, 6) as effect, round(effect / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) as standardized_effect, round(auc, 6) as auc, case when effect > 0 then 'positive' when effect < 0 then 'negative' else 'zero' end as direction, auc >= 0.5 and effect > 0 as passed from st join au using (cohort)")
def _(v):
    return show(M.cohort_concordance(cohort_scores(v), "EUROPE", 0.5)[0].drop("score_minimum", "score_maximum"))


@query("sig_concordance_verdict", sql=f"with {COHORTS} select bool_and(effect > 0) as direction_concordant, bool_and(auc >= 0.5) as all_meet_auc, max(hi - lo) / min(hi - lo) >= 2 as raw_scales_distinct, bool_and(auc >= 0.5 and effect > 0) as all_passed, bool_and(auc >= 0.5 and effect > 0) and max(hi - lo) / min(hi - lo) >= 2 as passed from st join au using (cohort)")
def _(v):
    return M.cohort_concordance(cohort_scores(v), "EUROPE", 0.5)[1]


# ---- experiments

ASSIGN = """asn as (select cast(user_id as varchar) || '-' || event_type || '-' || day(ts) as measurement_id, case when value < 1 then 'no' when value > 60 then 'maybe' else 'TRUE' end as include, case when value < 0.5 then 'low' else '' end as exclusion_reason, case when value between 50 and 55 then '' else event_type end as condition from events)"""


def event_assignments(v) -> DataFrame:
    value = F.col("value")
    return v.table("events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.dayofmonth("ts").cast("string")).alias("measurement_id"),
        F.when(value < 1, "no").when(value > 60, "maybe").otherwise("TRUE").alias("include"), F.when(value < 0.5, "low").otherwise("").alias("exclusion_reason"),
        F.when(value.between(50, 55), "").otherwise(F.col("event_type")).alias("condition"))


@query("exp_assignments", sql=f"""with {ASSIGN} select 'ERROR' as severity, 'ASSIGNMENT.DUPLICATE_MEASUREMENT' as code, measurement_id as subject from asn group by 3 having count(*) > 1 union all select 'ERROR', 'ASSIGNMENT.INVALID_INCLUDE', measurement_id from asn where include = 'maybe'
 union all select 'ERROR', 'ASSIGNMENT.EXCLUSION_REASON_REQUIRED', measurement_id from asn where include <> 'TRUE' and exclusion_reason = '' union all select 'ERROR', 'ASSIGNMENT.METADATA_REQUIRED', measurement_id from asn where include = 'TRUE' and condition = ''""")
def _(v):
    return E.check_assignments(event_assignments(v), ["condition"])


@query("exp_pairs", "a_pairs", sql="""select 'ERROR' as severity, 'DESIGN.PAIRED_CONDITIONS_INCOMPLETE' as code, biological_sample_id as subject from a_pairs group by 3 having count(*) filter (condition = 'view') <> 1 or count(*) filter (condition = 'purchase') <> 1
 union all select 'ERROR', 'DESIGN.INSUFFICIENT_COMPLETE_PAIRS', '' from (select biological_sample_id from a_pairs group by 1 having count(*) filter (condition = 'view') = 1 and count(*) filter (condition = 'purchase') = 1) having count(*) < 149""")
def _(v):
    return E.check_pairs(v.pairs, "view", "purchase", 149)


@query("exp_confounding", "a_pairs", sql="""with_c as (select distinct condition, run from a_pairs), a as (select condition, count(*) as k from with_c group by 1), b as (select run, count(*) as k from with_c group by 1)
 select 'run' as factor, (select count(*) from a) as conditions, (select count(*) from b) as levels, (select bool_and(k = 1) from a) and (select bool_and(k = 1) from b) as confounded, (select bool_or(k = 1) from a) and (select count(*) from b) > 1 as imbalanced""".replace("with_c as", ", with_c as", 1))
def _(v):
    return E.check_confounding(v.pairs, "condition", "run")


@query("exp_confounded", sql="select 'name' as factor, count(distinct n_nationkey) as conditions, count(distinct n_name) as levels, true as confounded, false as imbalanced from supplier join nation on s_nationkey = n_nationkey")
def _(v):
    rows = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return E.check_confounding(rows, "key", "name")


ORDERED = "lv as (select cast(o_custkey as varchar) as biological_sample_id, cast(substr(o_orderpriority, 1, 1) as double) as level, cast(o_orderkey as varchar) as measurement_id from orders), per as (select biological_sample_id, count(distinct level) as d, count(*) as n, count(*) filter (level = 5) as r from lv group by 1)"


def ordered_rows(v) -> DataFrame:
    return v.table("orders").select(F.col("o_custkey").cast("string").alias("biological_sample_id"), F.substring("o_orderpriority", 1, 1).cast("double").alias("level"),
                                    F.col("o_orderkey").cast("string").alias("measurement_id"))


@query("exp_levels", sql=f"with {ORDERED} select 'ERROR' as severity, 'DESIGN.PAIRED_REFERENCE_MISSING' as code, biological_sample_id as subject from per where r = 0 union all select 'ERROR', 'DESIGN.PAIRED_CHALLENGE_MISSING', biological_sample_id from per where d < 2")
def _(v):
    return E.check_levels(ordered_rows(v), 5.0)


@query("exp_levels_exact", sql=f"with {ORDERED} select 'ERROR' as severity, 'STUDY.PAIRED_LEVELS_INCOMPLETE' as code, biological_sample_id as subject from per where d <> 5 or n <> 5")
def _(v):
    return E.check_levels(ordered_rows(v), 5.0, exact=True)


@query("exp_precision", "a_replicates", sql="select 'ERROR' as severity, 'STUDY.FACTOR_CONFOUNDING' as code, '9 of 9' as subject from a_replicates where false union all select 'ERROR', 'STUDY.REPEATS_INSUFFICIENT', b from (select biological_sample_id || '-' || operator || '-' || day as b from a_replicates) group by b having count(*) < 2")
def _(v):
    rows = v.replicates.withColumn("biological_sample_id", F.concat_ws("-", "biological_sample_id", "operator", F.col("day").cast("string")))
    return E.check_precision(rows, ["operator", "call"])


ENDPOINT = """ep as (select sample_id as measurement_id, count(*) filter (value <> 0) as detected_genes, sum(value) / (select count(distinct feature_id) from a_cells) as mean_expression from a_cells group by 1)"""


def endpoints(v) -> DataFrame:
    return E.measurement_endpoints(v.measurement_cells, v.pairs.select("measurement_id", "biological_sample_id", "condition", "run", "quality_metric"))


@query("exp_endpoints", "a_cells", sql=f", {ENDPOINT} select measurement_id, detected_genes, round(mean_expression, 6) as mean_expression, false as technical_failure from ep")
def _(v):
    return show(endpoints(v).select("measurement_id", "detected_genes", "mean_expression", "technical_failure"))


PROFILE = """fe as (select distinct feature_id from a_cells), pk as (select a.measurement_id as left_id, b.measurement_id as right_id from a_pairs a join a_pairs b using (biological_sample_id) where a.condition = 'purchase' and b.condition = 'view'),
 gr as (select left_id, right_id, coalesce(x.value, 0) as x, coalesce(y.value, 0) as y from pk cross join fe left join a_cells x on x.sample_id = left_id and x.feature_id = fe.feature_id left join a_cells y on y.sample_id = right_id and y.feature_id = fe.feature_id),
 co as (select left_id, right_id, corr(x, y) as correlation from gr group by 1, 2)"""


@query("exp_profile_corr", "a_pairs", "a_cells", sql=f", {PROFILE} select left_id, right_id, round(correlation, 6) as correlation from co")
def _(v):
    sides = E.pair_sides(v.pairs, "view", "purchase", ["measurement_id"])
    keys = sides.select(F.col("comparator_measurement_id").alias("left_id"), F.col("reference_measurement_id").alias("right_id"))
    return show(E.profile_correlation(v.measurement_cells, keys))


PAIRS = f"""{PROFILE}, {ENDPOINT}, pt as (select l.biological_sample_id, right_id as reference_measurement_id, left_id as comparator_measurement_id, c.mean_expression - r.mean_expression as difference, (c.mean_expression + r.mean_expression) / 2 as average,
 c.detected_genes - r.detected_genes as detected_genes_difference, correlation, 1 - correlation as profile_discordance, l.quality_metric from co join ep c on c.measurement_id = left_id join ep r on r.measurement_id = right_id join a_pairs l on l.measurement_id = left_id)"""


def event_pairs(v) -> DataFrame:
    return E.pair_table(endpoints(v), v.measurement_cells, "view", "purchase")


@query("exp_pair_table", "a_pairs", "a_cells", sql=f""", {PAIRS} select biological_sample_id, reference_measurement_id, comparator_measurement_id, round(difference, 6) as difference, round(average, 6) as average, detected_genes_difference, round(correlation, 6) as correlation,
 round(profile_discordance, 6) as profile_discordance, false as reference_failure, false as comparator_failure, false as call_discordant, quality_metric from pt""")
def _(v):
    return show(event_pairs(v))


CI = "1.96 * stddev_samp({c}) / sqrt(count({c}))"


@query("exp_pair_summary", "a_pairs", "a_cells", sql=f""", {PAIRS} select count(*) as pair_count, round(avg(difference), 6) as mean_paired_difference, round(avg(difference) - {CI.format(c='difference')}, 6) as lower, round(avg(difference) + {CI.format(c='difference')}, 6) as upper,
 round(avg(correlation), 6) as mean_profile_correlation, round(avg(profile_discordance), 6) as mean_profile_discordance, 0.0 as reference_failure_rate, 0.0 as comparator_failure_rate, 0.0 as failure_rate_difference, 0::bigint as discordant_pair_count, round(median(correlation), 6) as median_profile_correlation from pt""")
def _(v):
    return show(E.pair_summary(cut(event_pairs(v))))


@query("exp_quality_slope", "a_pairs", "a_cells", sql=f""", {PAIRS}, s as (select count(*) as n, regr_slope(difference, quality_metric) as b, regr_sxx(difference, quality_metric) as sxx, regr_syy(difference, quality_metric) as syy, regr_sxy(difference, quality_metric) as sxy from pt)
 select 'ESTIMATED' as status, n as pair_count, round(b, 6) as slope, round(b - 1.96 * sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) as lower, round(b + 1.96 * sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) as upper from s""")
def _(v):
    return show(E.quality_slope(event_pairs(v)))


@query("exp_bland_altman", "a_pairs", "a_cells", sql=f", {PAIRS} select round(avg(difference), 6) as bias, round(stddev_samp(difference), 6) as sd, round(avg(difference) - 1.96 * stddev_samp(difference), 6) as lower_limit, round(avg(difference) + 1.96 * stddev_samp(difference), 6) as upper_limit from pt")
def _(v):
    return show(E.bland_altman(event_pairs(v)))


LEVELED = "lr as (select level, 1 - abs(score - 0.5) / (level * 4) as correlation, level * 2 as detected_genes, score as mean_expression from a_levels)"


def leveled(v) -> DataFrame:
    return v.levels.select("level", (1 - F.abs(F.col("score") - 0.5) / (F.col("level") * 4)).alias("correlation"), (F.col("level") * 2).alias("detected_genes"), F.col("score").alias("mean_expression"))


@query("exp_level_summary", "a_levels", sql=f""", {LEVELED} select level, count(*) as measurement_count, round(avg(correlation), 6) as mean_profile_correlation, round(avg(detected_genes), 6) as mean_detected_genes, round(avg(mean_expression), 6) as mean_expression,
 round(greatest(-1, avg(correlation) - {CI.format(c='correlation')}), 6) as lower, round(least(1, avg(correlation) + {CI.format(c='correlation')}), 6) as upper, round(median(correlation), 6) as median_profile_correlation, level = 5 as paired_reference, avg(correlation) >= 0.95 as stable from lr group by 1""")
def _(v):
    return show(E.level_summary(leveled(v), 5.0), "level")


@query("exp_lowest_level", "a_levels", sql=f", {LEVELED}, s as (select level, avg(correlation) >= 0.95 as stable from lr group by 1), u as (select level, bool_and(stable) over (order by level desc) as ok from s where level <> 5) select min(level) filter (ok) as lowest_level from u")
def _(v):
    return E.lowest_level(E.level_summary(leveled(v), 5.0), 5.0)


@query("exp_factor_balance", "a_pairs", sql="select condition, run, count(*) as measurement_count from a_pairs group by 1, 2")
def _(v):
    return E.factor_balance(v.pairs, "condition", "run")


@query("exp_confounding_matrix", "a_replicates", sql="select operator, count(*) filter (call = 'high') as high, count(*) filter (call = 'low') as low from a_replicates group by 1")
def _(v):
    return E.confounding_matrix(v.replicates, "operator", "call", ["high", "low"])


@query("exp_feasibility", "a_replicates", sql="""select factor, level, count(*) as measurement_count, count(*) filter (score >= 1) as successful_measurements, round(avg((score >= 1)::int), 6) as technical_success_rate, round(median(score), 6) as median_score, median(day) as median_day
 from (select score, day, unnest(['operator', 'call', 'all']) as factor, unnest([operator, case when call = 'low' then 'not_recorded' else call end, 'all']) as level from a_replicates) group by 1, 2""")
def _(v):
    rows = v.replicates.withColumn("technical_failure", F.col("score") < 1).withColumn("call", F.when(F.col("call") == "low", "").otherwise(F.col("call")))
    return show(E.feasibility_summary(rows, ["operator", "call"], ["score", "day"]), "median_day")


def factor_rows(v) -> DataFrame:
    return v.table("events").select(F.col("event_id").cast("string").alias("measurement_id"), F.col("user_id").cast("string").alias("biological_sample_id"), F.col("event_type").alias("kind"),
                                    F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("half"), F.weekday("ts").cast("string").alias("run"), F.col("value").alias("mean_expression"))


@query("exp_multifactor_check", sql="select 'ERROR' as severity, 'DESIGN.MULTIFACTOR_BOUNDS' as code, 'kind' as subject")
def _(v):
    return union(Y.check_multifactor(factor_rows(v), ["kind", "half"], [("kind", "half")]), Y.check_multifactor(factor_rows(v), ["kind"]))


@query("exp_multifactor_rank", sql="select count(distinct user_id) + (5 - 1) + 1 + 4 + 6 as rank, count(distinct user_id) + (5 - 1) + 1 + 4 + 6 as columns, count(*) as measurements from events")
def _(v):
    rank, columns, n = Y.multifactor_rank(factor_rows(v), ["kind", "half"], [("kind", "half")])
    one = v.table("events").agg(F.count(F.lit(1)).alias("measurements"))
    return one.select(F.lit(rank).cast("bigint").alias("rank"), F.lit(columns).cast("bigint").alias("columns"), "measurements")


@query("exp_multifactor_fit")
def _(v):
    return show(Y.multifactor_fit(factor_rows(v), ["kind", "half"], "mean_expression", [("kind", "half")])[0])


@query("exp_multifactor_cells", sql="select event_type as kind, case when hour(ts) < 12 then 'am' else 'pm' end as half, count(*) as measurement_count, round(avg(value), 6) as mean_expression from events group by 1, 2")
def _(v):
    return show(Y.multifactor_fit(factor_rows(v), ["kind", "half"], "mean_expression")[2])


# ---- studies

@query("stu_score_assignments", "m_embed", sql=f", {BIN} select cast(doc_id as varchar) as measurement_id, round(p, 6) as score, case when p is null then 'missing' else 'matched' end as match from documents left join pr on sample_id = cast(doc_id as varchar) union all select sample_id, round(p, 6), 'unexpected' from pr where sample_id not in (select cast(doc_id as varchar) from documents)")
def _(v):
    predicted = binary_prediction(v).select("sample_id", F.col("positive_probability").alias("score"), F.col("predicted_class").alias("call"))
    assignments = v.table("documents").select(F.col("doc_id").cast("string").alias("measurement_id"))
    return show(U.score_assignments(predicted, assignments).select("measurement_id", "score", "match"))


@query("stu_precision", "a_replicates", sql=""", p as (select biological_sample_id, count(*) as n, avg(score) as m, var_samp(score) as v from a_replicates group by 1), c as (select count(*) as k, avg(v) filter (n > 1) as w, avg(n) as r, var_samp(m) as o from p),
 t as (select *, greatest(0, o - w / r) as b, greatest(0, o - w / r) + w as tot from c), s as (select count(*) as n, avg(score) as m, stddev_samp(score) as sd from a_replicates)
 select n as measurement_count, k as biological_sample_count, round(m, 6) as mean, round(sd, 6) as sd, round(sd / m, 6) as cv, round(sqrt(w), 6) as repeatability_sd, round(sqrt(tot), 6) as reproducibility_sd, round(b, 6) as between_variance, round(w, 6) as repeatability_variance, round(tot, 6) as total_variance, round(b / tot, 6) as icc from t, s""")
def _(v):
    return show(U.precision_metrics(v.replicates))


@query("stu_ranges", "a_replicates", sql="select biological_sample_id, round(max(score) - min(score), 6) as range from a_replicates group by 1")
def _(v):
    return show(U.within_sample_ranges(v.replicates))


@query("stu_call_stability", "a_replicates", sql="with_n as (select biological_sample_id, call, count(*) as n from a_replicates group by 1, 2) select biological_sample_id, round(max(n) / sum(n), 6) as agreement, round(sum(n * (n - 1) / 2), 6) as stable_pairs, round(sum(n) * (sum(n) - 1) / 2, 6) as total_pairs from with_n group by 1".replace("with_n as", ", with_n as", 1))
def _(v):
    return show(U.call_stability(v.replicates))


@query("stu_call_agreement", "a_replicates", sql="with_n as (select biological_sample_id, call, count(*) as n from a_replicates group by 1, 2), s as (select sum(n * (n - 1) / 2) as a, sum(n) * (sum(n) - 1) / 2 as t from with_n group by biological_sample_id) select round(sum(a), 6) as stable_pairs, round(sum(t), 6) as total_pairs, round(sum(a) / sum(t), 6) as categorical_agreement from s".replace("with_n as", ", with_n as", 1))
def _(v):
    return show(U.call_agreement(v.replicates))


@query("stu_near_threshold", "a_replicates", sql="select measurement_id, score from a_replicates where abs(score - 10) <= 0.5")
def _(v):
    return U.near_threshold(v.replicates, 10.0, 0.5).select("measurement_id", "score")


BRIDGE = """br as (select a.biological_sample_id, a.value / 20 as reference_score, b.value / 20 as comparator_score, b.value / 20 - a.value / 20 as difference, (a.value >= 48) = (b.value >= 48) as call_agreement, b.run as comparator_run, b.quality_metric < 0.1 as qc_failure, b.n as comparator_n
 from a_pairs a join a_pairs b using (biological_sample_id) where a.condition = 'view' and b.condition = 'click')"""


def bridge(v) -> DataFrame:
    rows = v.pairs.withColumn("score", F.col("value") / 20).withColumn("call", F.when(F.col("value") >= 48, "high").otherwise("low"))
    return U.bridge_pairs(rows, "view", "click", ["run", "quality_metric", "n"]).withColumn("qc_failure", F.col("comparator_quality_metric") < 0.1)


@query("stu_bridge", "a_pairs", sql=f""", {BRIDGE}, s as (select count(*) as n, avg(difference) as b, stddev_samp(difference) as sd, {CI.format(c='difference')} as h, corr(reference_score, comparator_score) as r, avg(call_agreement::int) as ag from br)
 select n as pair_count, round(b, 6) as paired_bias, round(sd, 6) as paired_bias_sd, round(b - h, 6) as lower, round(b + h, 6) as upper, round(b - 1.96 * sd, 6) as lower_limit, round(b + 1.96 * sd, 6) as upper_limit, round(r, 6) as profile_correlation,
 round(ag, 6) as categorical_agreement, round(1 - ag, 6) as discordance_rate, b - h > -0.1 and b + h < 0.1 as equivalent from s""")
def _(v):
    return show(U.bridge_metrics(bridge(v), 0.1))


@query("stu_bridge_subgroups", "a_pairs", sql=f", {BRIDGE} select comparator_run as subgroup, count(*) as pair_count, round(avg(difference), 6) as mean_paired_bias, round(avg(call_agreement::int), 6) as categorical_agreement from br group by 1")
def _(v):
    return show(U.subgroup_review(bridge(v), "comparator_run"))


@query("stu_bridge_near", "a_pairs", sql=f", {BRIDGE} select biological_sample_id from br where least(abs(reference_score - 2.4), abs(comparator_score - 2.4)) <= 0.05")
def _(v):
    return U.near_threshold(bridge(v), 2.4, 0.05, ("reference_score", "comparator_score")).select("biological_sample_id")


@query("stu_deming", "a_pairs", sql=f""", {BRIDGE}, s as (select avg(reference_score) as mx, avg(comparator_score) as my, var_samp(reference_score) as sxx, var_samp(comparator_score) as syy, covar_samp(reference_score, comparator_score) as sxy from br),
 d as (select *, (syy - sxx + sqrt((syy - sxx) ** 2 + 4 * sxy ** 2)) / (2 * sxy) as b from s) select 'ESTIMATED' as status, round(b, 6) as slope, round(my - b * mx, 6) as intercept from d""")
def _(v):
    return show(U.deming(bridge(v)))


LEVELS = f"""dl as (select l.*, l.score - r.score as difference, l.call = r.call as agree from a_levels l left join a_levels r on r.biological_sample_id = l.biological_sample_id and r.level = 5),
 lm as (select level, count(*) as measurement_count, count(*) filter (difference is null) as unpaired_count, avg(score) as mean_score, avg(difference) as mean_score_difference, avg(abs(difference)) as mean_absolute_score_difference, avg(difference) - {CI.format(c='difference')} as lower, avg(difference) + {CI.format(c='difference')} as upper,
 avg(agree::int) as call_agreement_to_reference, count(*) filter (not agree) as threshold_crossing_count, avg(qc_failure::int) as qc_failure_rate from dl group by 1)"""


@query("stu_levels", "a_levels", sql=f""", {LEVELS} select level, measurement_count, unpaired_count, round(mean_score, 6) as mean_score, round(mean_score_difference, 6) as mean_score_difference, round(mean_absolute_score_difference, 6) as mean_absolute_score_difference, round(lower, 6) as lower, round(upper, 6) as upper,
 round(call_agreement_to_reference, 6) as call_agreement_to_reference, threshold_crossing_count, round(qc_failure_rate, 6) as qc_failure_rate from lm""")
def _(v):
    return show(U.level_metrics(v.levels, 5.0))


@query("stu_trend", "a_levels", sql=f""", {LEVELS}, st as (select level, lead(level) over (order by level desc) as lower_level, abs(lead(mean_score) over (order by level desc) - mean_score) as change from lm)
 select (select round(regr_slope(mean_score, level), 6) from lm) as slope, level as upper_level, lower_level, round(change, 6) as largest_change from st where lower_level is not null order by change desc limit 1""")
def _(v):
    return show(U.trend_and_change(U.level_metrics(v.levels, 5.0)))


RULES = [("a", "mean_absolute_score_difference", "classifier_score", "all_levels", 0.2), ("b", "call_agreement_to_reference", "predicted_class", "consecutive_levels", 0.5),
         ("c", "qc_failure_rate", "qc_failure", "lte", 0.001), ("d", "qc_failure_rate", "classifier_score", "lte", 0.5)]
RULES_SQL = "ru as (select * from (values " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e})" for a, b, c, d, e in RULES) + ") as t(criterion_id, metric, endpoint, operator, threshold))"
JUDGED = f"""{LEVELS}, {RULES_SQL}, lo as (select level, unnest(['mean_absolute_score_difference', 'call_agreement_to_reference', 'qc_failure_rate']) as metric, unnest([mean_absolute_score_difference, call_agreement_to_reference, qc_failure_rate]) as observed from lm where level <> 5),
 ju as (select ru.*, level, case when metric = 'call_agreement_to_reference' then observed >= threshold else observed <= threshold end as passes from lo join ru using (metric) where criterion_id <> 'd'),
 rn as (select *, bool_and(passes) over (partition by criterion_id order by level desc) as unbroken from ju)"""


def level_rules(v) -> DataFrame:
    return v.spark.createDataFrame(RULES, "criterion_id string, metric string, endpoint string, operator string, threshold double")


@query("stu_level_criteria", "a_levels", sql=f""", {JUDGED}, ag as (select criterion_id, count(*) filter (passes) as p, count(*) as n, count(*) filter (unbroken) as u from rn group by 1)
 select criterion_id, metric, operator, threshold::double as threshold, coalesce(p, 0) as passing_levels, case when n is null then 'NOT_APPLICABLE' when operator = 'consecutive_levels' then case when u >= 2 then 'PASS' else 'FAIL' end when p = n then 'PASS' else 'FAIL' end as status from ru left join ag using (criterion_id)""")
def _(v):
    return U.level_criteria(U.level_metrics(v.levels, 5.0), level_rules(v), 5.0)


@query("stu_candidate_level", "a_levels", sql=f", {JUDGED}, cm as (select level, bool_and(passes) as common from ju where criterion_id <> 'c' group by 1), cu as (select level, bool_and(common) over (order by level desc) as ok from cm) select min(level) filter (ok) as candidate_level from cu")
def _(v):
    return U.candidate_level(U.level_metrics(v.levels, 5.0), level_rules(v).where("criterion_id <> 'c'"), 5.0)


@query("stu_robustness", "a_pairs", sql=f""", {BRIDGE}, s as (select count(*) as n, avg(difference) as m, stddev_samp(difference) as sd, {CI.format(c='difference')} as h, avg((not call_agreement)::int) as ch, avg(qc_failure::int) as q from br)
 select n as pair_count, round(m, 6) as mean_challenge_effect, round(sd, 6) as challenge_effect_sd, round(m - h, 6) as lower, round(m + h, 6) as upper, m - h > -0.2 and m + h < 0.2 as effect_within_margin, round(ch, 6) as call_change_rate, round(q, 6) as qc_failure_rate from s""")
def _(v):
    return show(U.robustness_metrics(bridge(v), 0.2))


@query("stu_robustness_by_type", "a_pairs", sql=f", {BRIDGE} select comparator_run as challenge_type, count(*) as pair_count, round(avg(difference), 6) as mean_challenge_effect, round(avg((not call_agreement)::int), 6) as call_change_rate, round(avg(qc_failure::int), 6) as qc_failure_rate from br group by 1")
def _(v):
    return show(U.robustness_by_type(bridge(v).withColumnRenamed("comparator_run", "challenge_type")))


CRITERIA = [("a", "paired_bias", "classifier_score", "absolute_lte", [0.05]), ("b", "categorical_agreement", "predicted_class", "gte", [0.9]), ("c", "paired_bias", "classifier_score", "between", [-1.0, 1.0]),
            ("d", "profile_correlation", "classifier_score", "gt", [0.0]), ("e", "icc", "classifier_score", "gte", [0.5]), ("f", "discordance_rate", "predicted_class", "odd", [0.5]), ("g", "discordance_rate", "predicted_class", "lt", [0.99]),
            ("h", "tost_equivalence", "classifier_score", "gte", [1.0]), ("i", "qc_failure_rate", "qc_failure", "lte", [0.5])]


def study_results(v) -> DataFrame:
    metrics = U.study_metrics(U.bridge_metrics(bridge(v), 0.1))
    criteria = v.spark.createDataFrame(CRITERIA, "criterion_id string, metric string, endpoint string, operator string, threshold array<double>")
    return U.evaluate_criteria(metrics, criteria, "bridging")


JUDGE = f""", {BRIDGE}, s as (select avg(difference) as b, avg(call_agreement::int) as ag, corr(reference_score, comparator_score) as r, {CI.format(c='difference')} as h from br),
 cr as (select 'a' as criterion_id, 'paired_bias' as metric, 'absolute_lte' as operator, b as observed, case when abs(b) <= 0.05 then 'PASS' else 'FAIL' end as status from s union all select 'b', 'categorical_agreement', 'gte', ag, case when ag >= 0.9 then 'PASS' else 'FAIL' end from s
 union all select 'c', 'paired_bias', 'between', b, 'NOT_APPLICABLE' from s union all select 'd', 'profile_correlation', 'gt', r, 'NOT_APPLICABLE' from s union all select 'e', 'icc', 'gte', null, 'NOT_APPLICABLE' from s
 union all select 'f', 'discordance_rate', 'odd', 1 - ag, 'NOT_APPLICABLE' from s union all select 'g', 'discordance_rate', 'lt', 1 - ag, case when 1 - ag < 0.99 then 'PASS' else 'FAIL' end from s
 union all select 'h', 'tost_equivalence', 'gte', (b - h > -0.1 and b + h < 0.1)::int::double, case when b - h > -0.1 and b + h < 0.1 then 'PASS' else 'FAIL' end from s union all select 'i', 'qc_failure_rate', 'lte', null, 'NOT_APPLICABLE' from s)"""


@query("stu_criteria", "a_pairs", sql=f"{JUDGE} select criterion_id, metric, operator, round(observed, 6) as observed, status from cr")
def _(v):
    return show(study_results(v))


@query("stu_overall", "a_pairs", sql=f"{JUDGE} select count(*) as criteria, case when bool_or(status = 'FAIL') then 'FAIL' when bool_or(status in ('INDETERMINATE', 'NOT_APPLICABLE')) then 'INDETERMINATE' else 'PASS' end as overall_status from cr")
def _(v):
    return U.overall_status(study_results(v))
