"""D01-D13, E: detectors on the order matrix, their evaluation, overlap, agreement and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordertide.functions import clock
from ordertide.operators import detectors, evaluation, neighbours, ordered, performance, process, quality
from ordertide.plans.ctes import define, sql
from ordertide.plans.registry import query, rounded
from ordertide.session import materialize
from ordertide.sources.star_schema import FUNNEL

FEATURES = ["quantity", "price_cents", "discount_points"]
_U = [900, 950, 975, 990]
SRAW, SLOG, MED, IQR = "sraw", "slog", "median", "iqr"


def _fit_sql(expr, where="role='fit'"):
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, {expr(f)} AS v, role FROM meas" for f in FEATURES)
    return f"""WITH m AS ({rows}), q AS (SELECT feature, count(*) AS fit_rows, quantile_cont(v,0.01) AS q01, quantile_cont(v,0.25) AS q25, quantile_cont(v,0.5) AS median, quantile_cont(v,0.75) AS q75,
 {', '.join(f'quantile_cont(v,{u/1000}) AS u{u}' for u in _U)} FROM m WHERE {where} GROUP BY 1),
d AS (SELECT feature, quantile_cont(abs(v-median),0.5) AS mad FROM m JOIN q USING (feature) WHERE {where} GROUP BY 1) SELECT *, q75-q25 AS iqr FROM q JOIN d USING (feature)"""


define("sraw", _fit_sql(lambda f: f"{f}::DOUBLE"))
define("slog", _fit_sql(lambda f: f"ln(1+{f})"))
define("sall", _fit_sql(lambda f: f"{f}::DOUBLE", "true"))
STAT = ["q01", "q25", "median", "q75", *[f"u{u}" for u in _U], "mad", "iqr"]


def _g(table, feature, stat):
    return f"(SELECT {stat} FROM {table} WHERE feature='{feature}')"


_SCORES = {
    **{f"iqr_{k}": "greatest(0.0," + ",".join(f"({v(f)}-{_g(t, f, 'q75')})/{_g(t, f, 'iqr')}" for f in FEATURES) + ")"
       for k, t, v in [("raw", "sraw", lambda f: f), ("log1p", "slog", lambda f: f"ln(1+{f})")]},
    **{f"mad_{k}": "greatest(0.0," + ",".join(f"0.6744897501960817*({v(f)}-{_g(t, f, 'median')})/{_g(t, f, 'mad')}" for f in FEATURES) + ")"
       for k, t, v in [("raw", "sraw", lambda f: f), ("log1p", "slog", lambda f: f"ln(1+{f})")]},
    **{f"upper_u{u}": "greatest(" + ",".join(f"{f}-{_g('sraw', f, f'u{u}')}" for f in FEATURES) + ")" for u in _U}}
define("bs", " UNION ALL ".join(f"SELECT order_id, role, strftime(purchased_at,'%Y-%m') AS month, raw_status='F' AS y, '{k}' AS score_column, ({e})::DOUBLE AS score FROM meas WHERE role<>'fit'" for k, e in _SCORES.items()))
_FIXED = [(f"{fam}_{t}_k{round(k * 10):02d}", fam, f"{fam}_{t}", k) for t in ["raw", "log1p"] for fam, ks in [("iqr", [1.5, 3.0]), ("mad", [2.5, 3.0, 3.5])] for k in ks] + [
    (f"upper_q{u}", "upper_quantile", f"upper_u{u}", 0.0) for u in _U]
define("reg", "SELECT * FROM (VALUES " + ",".join(f"('{c}','{f}','{s}',{k}::DOUBLE)" for c, f, s, k in _FIXED) + ") v(candidate,family,score_column,threshold)")
define("flg", "SELECT bs.*, candidate, family, threshold, score>threshold AS flag FROM bs JOIN reg USING (score_column)")


def matrix(shop):
    """Read several times by most queries: one written table."""
    if "measured" not in shop.__dict__:
        shop.__dict__["measured"] = materialize(shop.measures, "measures")
    return shop.__dict__["measured"]


def stats(shop):
    fit = matrix(shop).where("role = 'fit'")
    return detectors.both_statistics(fit, FEATURES)


def scores(shop):
    """Scores feed thresholds, flags and every comparison: one written table."""
    if "scores" not in shop.__dict__:
        raw, logged = stats(shop)
        shop.__dict__["scores"] = materialize(detectors.base_scores(matrix(shop).where("role <> 'fit'"), FEATURES, raw, logged), "detector-scores")
    return shop.__dict__["scores"]


def flags(shop):
    f = detectors.apply_thresholds(scores(shop), detectors.calibrated_thresholds(scores(shop), []))
    labels = matrix(shop).select("order_id", clock.month(F.col("purchased_at")).alias("month"), (F.col("raw_status") == "F").alias("y"))
    return f.join(labels, "order_id")


@query("d02_iqr_fit_flags", sql(f"""SELECT order_id, concat_ws(',',{','.join(f"CASE WHEN {f}>{_g('sraw', f, 'q75')}+1.5*{_g('sraw', f, 'iqr')} THEN '{f}' END" for f in FEATURES)}) AS outlier_features FROM meas"""))
def iqr_fit(shop):
    return detectors.iqr_flags(matrix(shop), FEATURES, stats(shop)[0]).select("order_id", F.array_join("outlier_features", ",").alias("outlier_features"))


@query("d02_fit_statistics", sql(" UNION ALL ".join(f"SELECT '{n}' AS transform, feature, fit_rows, {','.join(f'round({c},6) AS {c}' for c in STAT)} FROM {t}" for n, t in [("raw", "sraw"), ("log1p", "slog")])))
def fit_statistics(shop):
    raw, logged = stats(shop)
    return rounded(raw.withColumn("transform", F.lit("raw")).unionByName(logged.withColumn("transform", F.lit("log1p"))))


@query("d03_threshold_grid", sql(" UNION ALL ".join(f"""SELECT '{f}' AS feature, (SELECT count(*) FROM meas) AS rows, '{m}' AS method, count(*) FILTER (WHERE {c}) AS outliers, round(count(*) FILTER (WHERE {c})/count(*),6) AS outlier_rate FROM (SELECT {f}::DOUBLE AS v, s.* FROM meas, sall s WHERE s.feature='{f}')"""
    for f in FEATURES for m, c in [("percentile_01_99", "v<q01 OR v>u990"), ("iqr_1_5", "v<q25-1.5*iqr OR v>q75+1.5*iqr"), ("iqr_3_0", "v<q25-3*iqr OR v>q75+3*iqr"), ("mad_z_3_5", "abs(0.6744897501960817*(v-median)/mad)>3.5")])))
def threshold_grid(shop):
    return rounded(detectors.threshold_grid(matrix(shop), FEATURES))


@query("d04_base_scores", sql("SELECT order_id, role, score_column, round(score,5) AS score FROM bs"))
def base_scores(shop):
    return rounded(scores(shop), 5)


define("ens0", """SELECT b.order_id, b.role, b.score_column, (SELECT count(*) FROM bs c WHERE c.role='calibration' AND c.score_column=b.score_column AND c.score<=b.score)/(SELECT count(*) FROM bs c WHERE c.role='calibration' AND c.score_column=b.score_column) AS r FROM bs b WHERE score_column IN ('iqr_log1p','mad_log1p','upper_u950')""")
MEMBERS = ["iqr_log1p", "mad_log1p", "upper_u950"]


@query("d05_calibrated_thresholds", sql(" UNION ALL ".join(f"SELECT score_column||'_tail{round(f * 1000):03d}' AS candidate, round(quantile_cont(score,{1 - f}),5) AS threshold, {f}::DOUBLE AS tail_fraction_loss FROM bs WHERE role='calibration' AND score_column IN ('iqr_log1p','mad_log1p') GROUP BY score_column" for f in [0.01, 0.025, 0.05, 0.1])
    + " UNION ALL SELECT candidate, round(threshold,5), NULL FROM reg"))
def calibrated(shop):
    r = detectors.calibrated_thresholds(scores(shop), ["iqr_log1p", "mad_log1p"])
    return rounded(r.select("candidate", "threshold", F.col("tail_fraction").alias("tail_fraction_loss")), 5)


@query("d06_apply_thresholds", sql("SELECT candidate, role, count(*) AS scored_cases, count(*) FILTER (WHERE flag) AS flagged FROM flg GROUP BY 1,2"))
def apply_thresholds(shop):
    return flags(shop).groupBy("candidate", "role").agg(F.count(F.lit(1)).alias("scored_cases"), F.count(F.when(F.col("flag"), 1)).alias("flagged"))


@query("d07_rank_ensemble", sql("""WITH c AS (SELECT score_column, score, count(*) AS n FROM bs WHERE role='calibration' AND score_column IN ('iqr_log1p','mad_log1p','upper_u950') GROUP BY 1,2),
cum AS (SELECT score_column, score, sum(n) OVER (PARTITION BY score_column ORDER BY score) AS upto, sum(n) OVER (PARTITION BY score_column) AS tot FROM c),
q AS (SELECT b.order_id, b.role, b.score_column, coalesce(upto,0)/(SELECT max(tot) FROM cum x WHERE x.score_column=b.score_column) AS r FROM (SELECT * FROM bs WHERE score_column IN ('iqr_log1p','mad_log1p','upper_u950')) b ASOF LEFT JOIN cum ON cum.score_column=b.score_column AND b.score>=cum.score),
e AS (SELECT order_id, role, avg(r) AS m, quantile_cont(r,0.5) AS md, max(r) FILTER (WHERE score_column='mad_log1p') AS mm FROM q GROUP BY 1,2)
SELECT order_id, role, 'ensemble_rank_mean' AS score_column, round(m,4) AS score FROM e UNION ALL SELECT order_id, role, 'ensemble_rank_median', round(md,4) FROM e UNION ALL SELECT order_id, role, 'hybrid_rank_mean_mad', round(0.5*m+0.5*mm,4) FROM e"""))
def rank_ensemble(shop):
    return rounded(detectors.rank_ensemble(scores(shop).withColumn("score", F.col("score")), MEMBERS), 4)


FORESTS = [("if_raw_256", False, 256), ("if_raw_512", False, 512), ("if_log1p_256", True, 256), ("if_log1p_512", True, 512)]


@query("d08_isolation_forest")
def isolation_forest(shop):
    """Four forests of 300 trees; SQL can't repeat the draws, so a small fixture checks growth and scores."""
    m, out = matrix(shop), None
    logs = m.select("order_id", "role", *[F.log1p(f).alias(f) for f in FEATURES])
    for name, log, samples in FORESTS:
        rows = logs if log else m
        nodes = detectors.isolation_forest_fit(rows.where("role = 'fit'"), FEATURES, samples=samples)
        scored = detectors.isolation_forest_score(rows.where("role <> 'fit'"), FEATURES, nodes, samples=samples).select(
            "order_id", "role", F.lit(name).alias("score_column"), "score")
        out = scored if out is None else out.unionByName(scored)
    return out


LOF_NEIGHBOURS = [20, 35, 50]
_LOF_AXES = [f"{f}_scaled" for f in FEATURES]
define("lofx", f"SELECT order_id, role, {', '.join(f'(ln(1+{f})-{_g(SLOG, f, MED)})/{_g(SLOG, f, IQR)} AS x{i}' for i, f in enumerate(FEATURES))} FROM meas")
define("lofn", """SELECT order_id, role, unnest(near).d AS d, unnest(near).o AS o, unnest(range(1, len(near)+1)) AS i FROM
 (SELECT q.order_id, q.role, min({'d': (q.x0-f.x0)**2+(q.x1-f.x1)**2+(q.x2-f.x2)**2, 'o': f.order_id}, 50) AS near FROM lofx q, (SELECT * FROM lofx WHERE role='fit') f WHERE f.order_id<>q.order_id GROUP BY 1,2)""")
define("lofk", "SELECT order_id AS o, i AS k, sqrt(d) AS kd FROM lofn WHERE role='fit' AND i IN (20,35,50)")
define("lofd", """SELECT n.order_id, n.role, k, 1/(avg(greatest(sqrt(d),kd))+1e-10) AS lrd FROM lofn n JOIN lofk USING (o) WHERE i<=k GROUP BY 1,2,3""")


@query("d09_local_outlier_factor", sql("""SELECT q.order_id, q.role, 'lof_log1p_'||q.k AS score_column, round(avg(f.lrd)/any_value(q.lrd),4) AS score
 FROM lofn n JOIN lofd q ON q.order_id=n.order_id AND n.i<=q.k JOIN lofd f ON f.order_id=n.o AND f.k=q.k WHERE n.role<>'fit' GROUP BY 1,2,3"""))
def local_outlier_factor(shop):
    m, logged = matrix(shop), stats(shop)[1]
    logs = m.select("order_id", "role", *[F.log1p(f).alias(f) for f in FEATURES])
    scaled = materialize(detectors.robust_scale(logs, FEATURES, logged, ("role",)), "scaled")
    found = neighbours.local_outlier_factors(scaled.where("role = 'fit'"), scaled.where("role <> 'fit'"), _LOF_AXES, LOF_NEIGHBOURS, keep=("role",))
    return rounded(found.select("order_id", "role", F.concat(F.lit("lof_log1p_"), F.col("neighbours").cast("string")).alias("score_column"), "score"), 4)


@query("d10_robust_scale", sql(f"SELECT order_id, {', '.join(f'round(({f}-{_g(SRAW, f, MED)})/{_g(SRAW, f, IQR)},6) AS {f}_scaled' for f in FEATURES)} FROM meas"))
def robust_scale(shop):
    return rounded(detectors.robust_scale(matrix(shop), FEATURES, stats(shop)[0]))


def funnel_evidence(shop):
    c = process.conformance(shop.funnel_log, FUNNEL)
    t = process.activity_times(shop.funnel_log, FUNNEL)
    negative = F.coalesce(F.col("view") < F.col("signup"), F.lit(False)) | F.coalesce(F.col("click") < F.col("view"), F.lit(False)) | F.coalesce(
        F.col("purchase") < F.col("click"), F.lit(False))
    gap = lambda a, b: clock.seconds_between(F.col(a), F.col(b))
    return c.join(t.select("case_id", negative.alias("has_negative_duration"), gap("signup", "view").alias("d1"), gap("view", "click").alias("d2"),
                           gap("click", "purchase").alias("d3")), "case_id")


define("ev", """SELECT c.*, coalesce(view<signup,false) OR coalesce(click<view,false) OR coalesce(purchase<click,false) AS has_negative_duration, CAST(floor(epoch(view)) AS BIGINT)-CAST(floor(epoch(signup)) AS BIGINT) AS d1,
  CAST(floor(epoch(click)) AS BIGINT)-CAST(floor(epoch(view)) AS BIGINT) AS d2, CAST(floor(epoch(purchase)) AS BIGINT)-CAST(floor(epoch(click)) AS BIGINT) AS d3
 FROM conf2 c JOIN (SELECT case_id, min(ts) FILTER (WHERE activity='signup') AS signup, min(ts) FILTER (WHERE activity='view') AS view, min(ts) FILTER (WHERE activity='click') AS click, min(ts) FILTER (WHERE activity='purchase') AS purchase FROM fun GROUP BY 1) t USING (case_id)""")


@query("d01_rule_flags", sql("""SELECT case_id, CASE WHEN r='' THEN 'none' ELSE r END AS rule_reasons, r<>'' AS rule_flag FROM (SELECT case_id, concat_ws('; ', CASE WHEN fitness<1 THEN 'low trace fitness' END, CASE WHEN missing_event_count>0 THEN 'missing event' END,
 CASE WHEN reversed_flag THEN 'reversed activity order' END, CASE WHEN has_negative_duration THEN 'negative duration' END) AS r FROM ev)"""))
def rule_flags(shop):
    return detectors.rule_flags(funnel_evidence(shop)).select("case_id", "rule_reasons", "rule_flag")


@query("f11_severity_of_deviation", sql("""SELECT case_id, CASE WHEN reversed_flag OR round(fitness,9)<0.5 THEN 'Severe' WHEN round(fitness,9)<0.8 THEN 'Significant' WHEN fitness<1 THEN 'Mild' ELSE 'Normal' END AS severity FROM ev"""))
def severity(shop):
    return process.conformance(shop.funnel_log, FUNNEL).select(
        "case_id", detectors.severity_of_deviation(F.round("fitness", 9), F.col("reversed_flag")).alias("severity"))


@query("f13_reasons_to_text", sql("""SELECT reasons, count(*) AS cases FROM (SELECT CASE WHEN r='' THEN 'none' ELSE r END AS reasons FROM (SELECT concat_ws('; ', CASE WHEN fitness<1 THEN 'low trace fitness' END, CASE WHEN missing_event_count>0 THEN 'missing event' END,
 CASE WHEN reversed_flag THEN 'reversed activity order' END, CASE WHEN has_negative_duration THEN 'negative duration' END) AS r FROM ev)) GROUP BY 1"""))
def reasons_text(shop):
    return detectors.rule_flags(funnel_evidence(shop)).groupBy(F.col("rule_reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("cases"))


@query("d11_vote_hybrid", sql("""SELECT order_id, v AS votes, v>=2 AS hybrid_anomaly, CASE WHEN v=0 THEN 'Normal' WHEN v=1 THEN 'Warning' WHEN v=2 THEN 'Anomaly' ELSE 'High-confidence anomaly' END AS anomaly_level FROM
 (SELECT order_id, sum(CAST(flag AS BIGINT))::BIGINT AS v FROM flg WHERE candidate IN ('iqr_raw_k15','mad_raw_k25','upper_q950') GROUP BY 1)"""))
def vote_hybrid(shop):
    three = ["iqr_raw_k15", "mad_raw_k25", "upper_q950"]
    wide = flags(shop).where(F.col("candidate").isin(three)).groupBy("order_id").agg(
        *[F.bool_or(F.when(F.col("candidate") == c, F.col("flag"))).alias(c) for c in three])
    return detectors.vote_hybrid(wide, three).select("order_id", "votes", "hybrid_anomaly", "anomaly_level")


@query("d13_classify_case", sql("""WITH c AS (SELECT *, CAST(coalesce(d1<0,false) AS INT)+CAST(coalesce(d2<0,false) AS INT)+CAST(coalesce(d3<0,false) AS INT) AS neg, CAST(coalesce(d1>259200,false) AS INT)+CAST(coalesce(d2>259200,false) AS INT)+CAST(coalesce(d3>259200,false) AS INT) AS lng,
  CAST(coalesce(d1>432000,false) AS INT)+CAST(coalesce(d2>432000,false) AS INT)+CAST(coalesce(d3>432000,false) AS INT) AS sev, CAST(coalesce(d1 BETWEEN 0 AND 599,false) AS INT)+CAST(coalesce(d2 BETWEEN 0 AND 599,false) AS INT)+CAST(coalesce(d3 BETWEEN 0 AND 599,false) AS INT) AS sh FROM ev),
s AS (SELECT *, reversed_flag OR neg>0 OR missing_event_count>=2 OR sev>0 OR lng>=2 AS strong, (missing_event_count>=1 AND lng>=1) OR (fitness<1 AND lng>=1) AS mid, missing_event_count=1 OR fitness<1 OR lng=1 OR sh>0 AS sus FROM c)
SELECT case_id, CASE WHEN strong OR mid THEN 'Anomaly' WHEN sus THEN 'Suspicious' ELSE 'Normal' END AS label, CASE WHEN strong OR NOT (strong OR mid OR sus) THEN 'High' WHEN mid THEN 'Medium' WHEN sh>0 AND lng=0 AND missing_event_count=0 THEN 'Low' ELSE 'Medium' END AS confidence FROM s"""))
def classify_case(shop):
    e = funnel_evidence(shop)
    total = lambda test: sum((F.coalesce(test(F.col(d)), F.lit(False)).cast("int") for d in ["d2", "d3"]), F.coalesce(test(F.col("d1")), F.lit(False)).cast("int"))
    label, confidence = detectors.classify_case(
        F.col("missing_event_count"), F.col("reversed_flag"), F.col("fitness"), total(lambda d: d < 0), total(lambda d: d > 259200),
        total(lambda d: d > 432000), total(lambda d: (d >= 0) & (d < 600)), F.lit(0))
    return e.select("case_id", label.alias("label"), confidence.alias("confidence"))


# --- evaluation ----------------------------------------------------------------------------------

CONF = """count(*) FILTER (WHERE y AND flag) AS tp, count(*) FILTER (WHERE NOT y AND flag) AS fp, count(*) FILTER (WHERE y AND NOT flag) AS fn, count(*) FILTER (WHERE NOT y AND NOT flag) AS tn"""
RATES = """round(tp/nullif(tp+fp,0),6) AS precision, round(tp/nullif(tp+fn,0),6) AS recall, round(2*tp/nullif(2*tp+fp+fn,0),6) AS f1, round(fp/nullif(fp+tn,0),6) AS fpr, round(tn/nullif(tn+fp,0),6) AS specificity, round((tp/nullif(tp+fn,0)+tn/nullif(tn+fp,0))/2,6) AS balanced_accuracy"""


@query("e01_confusion", sql(f"SELECT *, {RATES} FROM (SELECT candidate, {CONF}, CAST(0 AS BIGINT) AS unknown FROM flg WHERE role='validation' GROUP BY 1)"))
def confusion(shop):
    return rounded(evaluation.confusion(flags(shop).where("role = 'validation'"), ["candidate"], F.col("y"), F.col("flag")))


@query("e02_wilson_interval", """WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars>600) AS k FROM documents GROUP BY 1), p AS (SELECT *, k/n AS p, 1.959963984540054 AS z FROM c)
SELECT lang, n, k, round((p+z*z/(2*n)-z*sqrt(p*(1-p)/n+z*z/(4.0*n*n)))/(1+z*z/n),6) AS low, round((p+z*z/(2*n)+z*sqrt(p*(1-p)/n+z*z/(4.0*n*n)))/(1+z*z/n),6) AS high FROM p""")
def wilson(shop):
    c = shop.table("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_chars") > 600, 1)).alias("k"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return rounded(c.select("lang", "n", "k", low.alias("low"), high.alias("high")))


define("lab", "SELECT d.doc_id, d.lang, d.n_chars, l.quality=1 AS y, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")


def labelled(shop):
    return shop.table("documents").select("doc_id", "lang", "n_chars").join(shop.table("labels"), "doc_id", "left").withColumn("y", F.col("quality") == 1)


@query("e03_roc_auc", sql("""WITH k AS (SELECT * FROM lab WHERE y IS NOT NULL)
SELECT lang, count(*) FILTER (WHERE y) AS positives, count(*) FILTER (WHERE NOT y) AS negatives, round((SELECT sum(CASE WHEN a.n_chars>b.n_chars THEN 1.0 WHEN a.n_chars=b.n_chars THEN 0.5 ELSE 0 END) FROM k a JOIN k b ON a.lang=b.lang AND a.y AND NOT b.y WHERE a.lang=k.lang)
 /nullif(count(*) FILTER (WHERE y)*count(*) FILTER (WHERE NOT y),0),6) AS roc_auc FROM k GROUP BY 1"""))
def roc_auc(shop):
    return rounded(evaluation.roc_auc(labelled(shop), ["lang"], F.col("y"), "n_chars", width=ordered.UNITS))


CURVE = """WITH k AS (SELECT n_chars AS t, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM lab WHERE y IS NOT NULL GROUP BY 1),
c AS (SELECT t, p, sum(p) OVER w::BIGINT AS tp, sum(n) OVER w::BIGINT AS fp, (SELECT sum(p) FROM k)::BIGINT AS np, (SELECT sum(n) FROM k)::BIGINT AS nn FROM k WINDOW w AS (ORDER BY t DESC))"""


@query("e04_average_precision", sql(CURVE + " SELECT max(np) AS positives, round(sum(p*tp/(tp+fp))/max(np),6) AS average_precision FROM c"))
def average_precision(shop):
    return rounded(evaluation.average_precision(labelled(shop), [], F.col("y"), "n_chars", width=ordered.UNITS))


@query("e05_curves", sql(CURVE + " SELECT t AS threshold, tp, fp, round(tp/np,6) AS tpr, round(fp/nn,6) AS fpr, round(tp/(tp+fp),6) AS precision FROM c"))
def curves(shop):
    return rounded(evaluation.curves(labelled(shop), [], F.col("y"), "n_chars", width=ordered.UNITS))


@query("e06_score_availability", sql("""SELECT CASE WHEN y IS NULL AND s IS NULL THEN 'missing_target_and_score' WHEN y IS NULL THEN 'missing_target' WHEN s IS NULL THEN 'missing_score' ELSE 'evaluated' END AS availability, count(*) AS cases
FROM (SELECT y, CASE WHEN n_chars<2000 THEN n_chars END AS s FROM lab) GROUP BY 1"""))
def score_availability(shop):
    s = F.when(F.col("n_chars") < 2000, F.col("n_chars"))
    return labelled(shop).groupBy(evaluation.availability(F.col("y"), s).alias("availability")).agg(F.count(F.lit(1)).alias("cases"))


@query("e07_pairwise_overlap", sql("""WITH v AS (SELECT * FROM flg WHERE role='validation'), c AS (SELECT candidate, count(*) FILTER (WHERE flag) AS n, count(*) AS tot FROM v GROUP BY 1),
b AS (SELECT x.candidate AS l, y.candidate AS r, count(*) AS n FROM v x JOIN v y ON x.order_id=y.order_id AND x.candidate<y.candidate AND x.flag AND y.flag GROUP BY 1,2)
SELECT c1.candidate AS left_candidate, c2.candidate AS right_candidate, c1.tot AS scored_cases, coalesce(b.n,0) AS both_flag, c1.n-coalesce(b.n,0) AS left_only, c2.n-coalesce(b.n,0) AS right_only, c1.tot-c1.n-c2.n+coalesce(b.n,0) AS neither_flag,
 c1.n+c2.n-coalesce(b.n,0) AS union_flags, round(coalesce(b.n,0)/nullif(c1.n+c2.n-coalesce(b.n,0),0),6) AS jaccard_overlap, c1.n=coalesce(b.n,0) AND c2.n=coalesce(b.n,0) AS identical_observed_flags
FROM c c1 JOIN c c2 ON c1.candidate<c2.candidate LEFT JOIN b ON b.l=c1.candidate AND b.r=c2.candidate"""))
def pairwise(shop):
    return rounded(evaluation.pairwise_overlap(flags(shop).where("role = 'validation'")))


define("rul", """SELECT order_id, 'delivered_status' AS rule, raw_status='F' AS signal FROM meas UNION ALL SELECT order_id, 'big_discount', CASE WHEN quantity>20 THEN discount_points>20 END FROM meas""")


@query("e08_rule_overlap", sql("""SELECT candidate, rule, count(signal) AS compared_cases, count(*) FILTER (WHERE signal IS NULL) AS rule_unavailable_cases, count(*) FILTER (WHERE flag AND signal) AS both_flag, count(*) FILTER (WHERE flag AND NOT signal) AS candidate_only,
 count(*) FILTER (WHERE NOT flag AND signal) AS rule_only, count(*) FILTER (WHERE NOT flag AND NOT signal) AS neither_flag, round(count(*) FILTER (WHERE flag AND signal)/nullif(count(*) FILTER (WHERE (flag AND signal IS NOT NULL) OR (NOT flag AND signal)),0),6) AS jaccard_overlap
FROM flg JOIN rul USING (order_id) WHERE role='validation' GROUP BY 1,2"""))
def rule_overlap(shop):
    m = matrix(shop)
    rules = m.select("order_id", F.expr("stack(2, 'delivered_status', raw_status = 'F', 'big_discount', CASE WHEN quantity > 20 THEN discount_points > 20 END) AS (rule, signal)"))
    return rounded(evaluation.rule_overlap(flags(shop).where("role = 'validation'").select("order_id", "candidate", "flag"), rules))


@query("e09_observed_equivalence", sql("""WITH p AS (SELECT candidate, count(*) FILTER (WHERE flag) AS flagged, coalesce(string_agg(order_id::VARCHAR,',' ORDER BY order_id) FILTER (WHERE flag),'') AS k FROM flg WHERE role='validation' GROUP BY 1)
SELECT string_agg(candidate,',' ORDER BY candidate) AS members, count(*) AS candidates, flagged FROM p GROUP BY flagged, k"""))
def equivalence(shop):
    return evaluation.observed_equivalence(flags(shop).where("role = 'validation'"))


define("mon", "SELECT candidate, month, count(*) AS scored_cases, count(*) FILTER (WHERE flag) AS flagged, count(*) FILTER (WHERE flag)/count(*) AS rate FROM flg WHERE role='validation' GROUP BY 1,2")


@query("e10_candidate_stability", sql("""SELECT candidate, count(*) AS months, sum(scored_cases)::BIGINT AS scored_cases, sum(flagged)::BIGINT AS flagged, round(sum(flagged)/sum(scored_cases),6) AS rate, round(min(rate),6) AS rate_min, round(max(rate),6) AS rate_max, round(100*(max(rate)-min(rate)),6) AS rate_range_pp,
 round(100*sqrt(greatest(0.0, sum(scored_cases*rate*rate)/sum(scored_cases)-(sum(flagged)/sum(scored_cases))*(sum(flagged)/sum(scored_cases)))),5) AS rate_weighted_sd_pp FROM mon GROUP BY 1"""))
def stability(shop):
    out = evaluation.candidate_stability(evaluation.monthly_rates(flags(shop).where("role = 'validation'")))
    return rounded(out).withColumn("rate_weighted_sd_pp", F.round("rate_weighted_sd_pp", 5))


@query("e10_calibration_gap", sql("""SELECT candidate, count(*) FILTER (WHERE role='calibration') AS calibration_cases, count(*) FILTER (WHERE role='validation') AS validation_cases, round(count(*) FILTER (WHERE role='calibration' AND flag)/count(*) FILTER (WHERE role='calibration'),6) AS calibration_rate,
 round(count(*) FILTER (WHERE role='validation' AND flag)/count(*) FILTER (WHERE role='validation'),6) AS validation_rate, round(100*(count(*) FILTER (WHERE role='validation' AND flag)/count(*) FILTER (WHERE role='validation')-count(*) FILTER (WHERE role='calibration' AND flag)/count(*) FILTER (WHERE role='calibration')),6) AS gap_pp FROM flg GROUP BY 1"""))
def calibration_gap(shop):
    return rounded(evaluation.calibration_gap(flags(shop)))


@query("e11_threshold_sensitivity", sql("""WITH p AS (SELECT score_column, candidate, threshold, count(*) FILTER (WHERE flag) AS f FROM flg WHERE role='validation' GROUP BY 1,2,3), n AS (SELECT *, lead(candidate) OVER w AS sc, lead(threshold) OVER w AS st, lead(f) OVER w AS sf FROM p WINDOW w AS (PARTITION BY score_column ORDER BY threshold, candidate))
SELECT score_column, candidate AS looser_candidate, sc AS stricter_candidate, threshold AS looser_threshold, st AS stricter_threshold, f AS looser_flags, sf AS stricter_flags, f-sf AS removed_flags, f=sf AS observed_plateau FROM n WHERE sc IS NOT NULL"""))
def sensitivity(shop):
    return evaluation.threshold_sensitivity(flags(shop).where("role = 'validation'"))


@query("w09_adjacent_thresholds", sql("""SELECT score_column, candidate, threshold, next_threshold FROM (SELECT *, lead(threshold) OVER (PARTITION BY score_column ORDER BY threshold, candidate) AS next_threshold FROM reg) WHERE next_threshold IS NOT NULL
 AND (SELECT count(*) FROM bs)>0"""))
def adjacent(shop):
    return evaluation.threshold_sensitivity(flags(shop)).select("score_column", F.col("looser_candidate").alias("candidate"),
                                                                F.col("looser_threshold").alias("threshold"), F.col("stricter_threshold").alias("next_threshold"))


define("cf", f"SELECT *, round(2*tp/nullif(2*tp+fp+fn,0),9) AS f1, round(tp/nullif(tp+fp,0),9) AS prec, round(tp/nullif(tp+fn,0),9) AS rec FROM (SELECT candidate, family, {CONF} FROM flg WHERE role='validation' GROUP BY 1,2)")


def confusions(shop):
    return evaluation.confusion(flags(shop).where("role = 'validation'"), ["candidate", "family"], F.col("y"), F.col("flag"))


@query("e12_family_summary", sql("""SELECT family, round(lo,6) AS metric_min, round(hi,6) AS metric_max, n AS candidates, string_agg(candidate,',' ORDER BY candidate) AS leaders FROM cf JOIN (SELECT family, min(f1) AS lo, max(f1) AS hi, count(*) AS n FROM cf GROUP BY 1) USING (family) WHERE f1=hi GROUP BY 1,2,3,4"""))
def family_summary(shop):
    return rounded(evaluation.family_summary(confusions(shop).withColumn("f1", F.round("f1", 9)), "family", "f1"))


@query("j14_pareto_frontier", """WITH s AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, -sum(CAST(round(l_discount*100) AS BIGINT))::BIGINT AS discount_rank FROM lineitem GROUP BY 1)
SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.quantity>=a.quantity AND b.discount_rank>=a.discount_rank AND (b.quantity>a.quantity OR b.discount_rank>a.discount_rank))""")
def pareto(shop):
    s = shop.table("lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
                                                        (-F.sum(F.round(F.col("l_discount") * 100).cast("long"))).alias("discount_rank"))
    return evaluation.pareto_frontier(s, "l_suppkey", ["quantity", "discount_rank"], width=ordered.UNITS)


@query("j14_pareto_frontier_candidates", sql("""SELECT candidate, round(prec,6) AS precision, round(rec,6) AS recall, round(-fpr,6) AS neg_fpr FROM (SELECT *, round(fp/nullif(fp+tn,0),9) AS fpr FROM cf) a WHERE prec IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM (SELECT *, round(fp/nullif(fp+tn,0),9) AS fpr FROM cf) b WHERE b.prec>=a.prec AND b.rec>=a.rec AND b.fpr<=a.fpr AND (b.prec>a.prec OR b.rec>a.rec OR b.fpr<a.fpr))"""))
def pareto_candidates(shop):
    c = confusions(shop).where("precision IS NOT NULL").select("candidate", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"),
                                                               (-F.round("fpr", 9)).alias("neg_fpr"))
    return rounded(evaluation.pareto_frontier(c, "candidate", ["precision", "recall", "neg_fpr"]))


@query("j14_pareto_frontier_three", """WITH s AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, -sum(CAST(round(l_discount*100) AS BIGINT))::BIGINT AS discount_rank, max(CAST(round(l_extendedprice*100) AS BIGINT))::BIGINT AS top_cents FROM lineitem GROUP BY 1)
SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.quantity>=a.quantity AND b.discount_rank>=a.discount_rank AND b.top_cents>=a.top_cents AND (b.quantity>a.quantity OR b.discount_rank>a.discount_rank OR b.top_cents>a.top_cents))""")
def pareto_three(shop):
    s = shop.table("lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), (-F.sum(F.round(F.col("l_discount") * 100).cast("long"))).alias("discount_rank"),
                                                        F.max(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("top_cents"))
    return evaluation.pareto_frontier(s, "l_partkey", ["quantity", "discount_rank", "top_cents"])


@query("e13_signal_cooccurrence", sql("""SELECT candidate, month, count(*) FILTER (WHERE flag) AS flagged, count(*) FILTER (WHERE y) AS signals, count(*) FILTER (WHERE flag AND y) AS both, grouping_id(month, candidate) AS grouping
FROM flg WHERE role='validation' GROUP BY GROUPING SETS ((candidate),(candidate,month))"""))
def cooccurrence(shop):
    f = flags(shop).where("role = 'validation'")
    n = lambda c: F.count(F.when(c, 1))
    return f.groupingSets([[F.col("candidate")], [F.col("candidate"), F.col("month")]], F.col("month"), F.col("candidate")).agg(
        n(F.col("flag")).alias("flagged"), n(F.col("y")).alias("signals"), n(F.col("flag") & F.col("y")).alias("both"), F.grouping_id().alias("grouping"))


# Training windows: nested histories that end where calibration begins, each fitted anew.
WINDOWS = {"full_history": "1900-01-01", "last_24_months": "1996-01-01", "last_12_months": "1997-01-01", "last_6_months": "1997-07-01"}


def _window_sql():
    values = ",".join(f"('{w}',TIMESTAMP '{start}',{1 << i})" for i, (w, start) in enumerate(WINDOWS.items()))
    define("twin", f"SELECT * FROM (VALUES {values}) v(win,starts,bit)")
    for name, v in [("wraw", lambda f: f"{f}::DOUBLE"), ("wlog", lambda f: f"ln(1+{f})")]:
        rows = " UNION ALL ".join(f"SELECT win, '{f}' AS feature, {v(f)} AS v FROM meas, twin w WHERE role='fit' AND purchased_at>=starts" for f in FEATURES)
        define(f"{name}m", rows)
        define(f"{name}q", f"SELECT win, feature, quantile_cont(v,0.25) AS q25, quantile_cont(v,0.5) AS median, quantile_cont(v,0.75) AS q75, {', '.join(f'quantile_cont(v,{u / 1000}) AS u{u}' for u in _U)} FROM {name}m GROUP BY 1,2")
        define(name, f"SELECT q.*, q75-q25 AS iqr, mad FROM {name}q q JOIN (SELECT win, feature, quantile_cont(abs(v-median),0.5) AS mad FROM {name}m JOIN {name}q USING (win, feature) GROUP BY 1,2) USING (win, feature)")
    # Scores per feature and window first, then the greatest over features.
    parts = []
    for f in FEATURES:
        for k, t, v in [("raw", "wraw", f), ("log1p", "wlog", f"ln(1+{f})")]:
            parts.append(f"SELECT order_id, win, 'iqr_{k}' AS score_column, ({v}-q75)/iqr AS s FROM meas JOIN {t} ON feature='{f}' WHERE role='validation'")
            parts.append(f"SELECT order_id, win, 'mad_{k}', 0.6744897501960817*({v}-median)/mad FROM meas JOIN {t} ON feature='{f}' WHERE role='validation'")
        parts += [f"SELECT order_id, win, 'upper_u{u}', {f}-u{u} FROM meas JOIN wraw ON feature='{f}' WHERE role='validation'" for u in _U]
    define("wscore", "SELECT order_id, win, score_column, max(s) AS score FROM (" + " UNION ALL ".join(parts) + ") GROUP BY 1,2,3")
    define("wvote", """SELECT order_id, candidate, family, sum(CASE WHEN score>threshold THEN bit ELSE 0 END)::BIGINT AS bits FROM wscore JOIN reg USING (score_column) JOIN twin USING (win) GROUP BY 1,2,3""")


_window_sql()


def window_votes(shop):
    """All windows are fitted, scored and compared in one plan; the window is a key of the fit."""
    if "window_votes" not in shop.__dict__:
        m = matrix(shop)
        starts = F.inline(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(s).cast("timestamp_ntz").alias("starts")) for w, s in WINDOWS.items()]))
        fit = m.where("role = 'fit'").select(*m.columns, starts).where("purchased_at >= starts")
        raw, logged = detectors.both_statistics(fit, FEATURES, ["window"])
        scored = detectors.base_scores(m.where("role = 'validation'"), FEATURES, raw, logged, ["window"])
        found = detectors.apply_thresholds(scored, detectors.calibrated_thresholds(scored, []))
        shop.__dict__["window_votes"] = materialize(evaluation.window_votes(found, list(WINDOWS)), "window-votes")
    return shop.__dict__["window_votes"]


_BITS = [f"sum((bits>>{i})&1)" for i in range(len(WINDOWS))]
_ALL = (1 << len(WINDOWS)) - 1


@query("e15_window_stability", sql(f"""SELECT candidate, family, {len(WINDOWS)}::BIGINT AS windows_evaluated, count(*) AS scored_cases_per_window, least({','.join(_BITS)})::BIGINT AS min_flagged_cases, greatest({','.join(_BITS)})::BIGINT AS max_flagged_cases,
 round(100.0*(greatest({','.join(_BITS)})-least({','.join(_BITS)}))/count(*),6)::DOUBLE AS flag_rate_range_pp, count(*) FILTER (WHERE bits={_ALL}) AS cases_flagged_in_every_window, count(*) FILTER (WHERE bits>0) AS cases_flagged_in_any_window,
 count(*) FILTER (WHERE bits>0 AND bits<{_ALL}) AS cases_with_changed_decision, round(count(*) FILTER (WHERE bits>0 AND bits<{_ALL})/count(*),6) AS changed_decision_fraction FROM wvote GROUP BY 1,2"""))
def window_stability(shop):
    return rounded(evaluation.window_stability(window_votes(shop), list(WINDOWS)))


@query("e15_window_changes", sql(f"""SELECT order_id, candidate, family, {len(WINDOWS)}::BIGINT AS windows_evaluated, bit_count(bits)::BIGINT AS windows_flagged,
 concat_ws(',',{','.join(f"CASE WHEN (bits>>{i})&1=1 THEN '{w}' END" for i, w in enumerate(WINDOWS))}) AS flagged_windows FROM wvote WHERE bits>0 AND bits<{_ALL}"""))
def window_changes(shop):
    return evaluation.window_changes(window_votes(shop), list(WINDOWS)).withColumn("flagged_windows", F.array_join("flagged_windows", ","))


@query("e15_window_agreement", sql("""SELECT candidate, family, a.win AS left_window, b.win AS right_window, count(*) AS scored_cases, count(*) FILTER (WHERE bits&a.bit>0 AND bits&b.bit>0) AS both_flag, count(*) FILTER (WHERE bits&a.bit>0 AND bits&b.bit=0) AS left_only,
 count(*) FILTER (WHERE bits&a.bit=0 AND bits&b.bit>0) AS right_only, count(*) FILTER (WHERE bits&(a.bit|b.bit)=0) AS neither_flag, count(*) FILTER (WHERE bits&(a.bit|b.bit)>0) AS union_flags,
 count(*) FILTER (WHERE (bits&a.bit>0)<>(bits&b.bit>0)) AS changed_decisions, round(count(*) FILTER (WHERE bits&a.bit>0 AND bits&b.bit>0)/nullif(count(*) FILTER (WHERE bits&(a.bit|b.bit)>0),0),6) AS jaccard_overlap,
 round(count(*) FILTER (WHERE (bits&a.bit>0)<>(bits&b.bit>0))/count(*),6) AS changed_decision_fraction FROM wvote, twin a, twin b WHERE a.bit<b.bit GROUP BY 1,2,3,4"""))
def window_agreement(shop):
    return rounded(evaluation.window_agreement(window_votes(shop), list(WINDOWS)))


def monthly_confusion(shop):
    return evaluation.confusion(flags(shop).where("role = 'validation'").withColumnRenamed("month", "period"), ["candidate", "period"], F.col("y"), F.col("flag"))


define("mcf", f"SELECT candidate, month AS period, {CONF} FROM flg WHERE role='validation' GROUP BY 1,2")
_SEL = """SELECT *, m AND w_ AND pooled_f1>=max(CASE WHEN m AND w_ THEN pooled_f1 END) OVER (PARTITION BY removed)-1e-12 AS chosen FROM (SELECT *, m AND worst_f1>=max(CASE WHEN m THEN worst_f1 END) OVER (PARTITION BY removed)-1e-12 AS w_ FROM (SELECT *, macro_f1>=max(macro_f1) OVER (PARTITION BY removed)-1e-12 AS m FROM t))"""


@query("e16_temporal_selection", sql(f"""WITH t AS (SELECT 'x' AS removed, candidate, count(*) AS eligible_months, avg(coalesce(2*tp/nullif(2*tp+fp+fn,0),0)) AS macro_f1, min(coalesce(2*tp/nullif(2*tp+fp+fn,0),0)) AS worst_f1, max(p) AS pooled_f1
 FROM mcf JOIN (SELECT candidate, 2*sum(tp)/nullif(2*sum(tp)+sum(fp)+sum(fn),0) AS p FROM mcf GROUP BY 1) USING (candidate) WHERE tp+fn>0 AND fp+tn>0 GROUP BY 1,2)
SELECT candidate, eligible_months, round(macro_f1,6) AS macro_f1, round(worst_f1,6) AS worst_f1, round(pooled_f1,6) AS pooled_f1, chosen FROM ({_SEL})"""))
def temporal_selection(shop):
    m = monthly_confusion(shop)
    pooled = confusions(shop).select("candidate", F.col("f1").alias("pooled_f1"))
    return rounded(evaluation.temporal_selection(m, pooled))


@query("e17_leave_one_period_out", sql(f"""WITH kept AS (SELECT p.period AS removed, m.* FROM mcf m, (SELECT DISTINCT period FROM mcf) p WHERE m.period<>p.period),
t AS (SELECT removed, candidate, count(*) AS eligible_months, avg(coalesce(2*tp/nullif(2*tp+fp+fn,0),0)) AS macro_f1, min(coalesce(2*tp/nullif(2*tp+fp+fn,0),0)) AS worst_f1, max(p) AS pooled_f1
 FROM kept JOIN (SELECT removed, candidate, 2*sum(tp)/nullif(2*sum(tp)+sum(fp)+sum(fn),0) AS p FROM kept GROUP BY 1,2) USING (removed, candidate) WHERE tp+fn>0 AND fp+tn>0 GROUP BY 1,2)
SELECT removed, candidate, round(macro_f1,6) AS macro_f1 FROM ({_SEL}) WHERE chosen"""))
def leave_one_out(shop):
    m = materialize(monthly_confusion(shop), "monthly-confusion")
    return rounded(evaluation.leave_one_period_out(m, m).select("removed", "candidate", "macro_f1"))


@query("e18_cost_sensitivity", sql("SELECT candidate, fp, fn, r::DOUBLE AS cost_ratio, (fp+r*fn)::DOUBLE AS cost FROM cf, (VALUES (0.5),(1.0),(2.0),(5.0)) v(r)"))
def cost(shop):
    return evaluation.cost_sensitivity(confusions(shop), [0.5, 1.0, 2.0, 5.0])


@query("e19_period_coverage", sql("""SELECT month, count(*) AS orders, count(*) FILTER (WHERE scored) AS compared, count(*) FILTER (WHERE NOT scored AND raw_status='F') AS excluded_known, count(*) FILTER (WHERE NOT scored AND raw_status<>'F') AS excluded_unknown
FROM (SELECT strftime(o_orderdate,'%Y-%m') AS month, o_orderstatus AS raw_status, o_orderkey IN (SELECT order_id FROM bs) AS scored FROM orders) GROUP BY 1"""))
def period_coverage(shop):
    scored = scores(shop).select("order_id").distinct().withColumn("scored", F.lit(True))
    o = shop.table("orders").select(F.col("o_orderkey").alias("order_id"), clock.month(F.col("o_orderdate")).alias("month"), "o_orderstatus").join(scored, "order_id", "left")
    s = F.coalesce("scored", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    return o.groupBy("month").agg(F.count(F.lit(1)).alias("orders"), n(s).alias("compared"), n(~s & (F.col("o_orderstatus") == "F")).alias("excluded_known"),
                                  n(~s & (F.col("o_orderstatus") != "F")).alias("excluded_unknown"))


@query("e24_ks_wasserstein", """WITH v AS (SELECT l_returnflag, CAST(round(l_extendedprice*100) AS BIGINT) AS x, l_shipdate<TIMESTAMP '1998-01-01' AS f FROM lineitem),
t AS (SELECT l_returnflag, x, count(*) FILTER (WHERE f) AS a, count(*) FILTER (WHERE NOT f) AS b FROM v GROUP BY 1,2),
c AS (SELECT *, sum(a) OVER w/sum(a) OVER g AS fa, sum(b) OVER w/sum(b) OVER g AS fb, sum(a) OVER g AS na, sum(b) OVER g AS nb, lead(x) OVER w AS nx FROM t WINDOW w AS (PARTITION BY l_returnflag ORDER BY x), g AS (PARTITION BY l_returnflag))
SELECT l_returnflag, max(na)::BIGINT AS first_cases, max(nb)::BIGINT AS second_cases, round(max(abs(fa-fb)),6) AS ks_distance, round(sum(abs(fa-fb)*(nx-x)),4) AS wasserstein FROM c GROUP BY 1""")
def ks(shop):
    v = shop.table("lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("x"),
                                      (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("f"))
    out = evaluation.ks_and_wasserstein(v, ["l_returnflag"], "x", F.col("f"), width=ordered.UNITS)
    return out.withColumns({"ks_distance": F.round("ks_distance", 6), "wasserstein": F.round("wasserstein", 4)})


@query("e26_quantile_shift", """WITH v AS (SELECT l_shipdate<TIMESTAMP '1998-01-01' AS f, CAST(round(l_extendedprice*100) AS BIGINT)::DOUBLE AS x FROM lineitem)
SELECT round(quantile_cont(x,0.5) FILTER (WHERE NOT f)-quantile_cont(x,0.5) FILTER (WHERE f),4) AS median_shift, round(quantile_cont(x,0.9) FILTER (WHERE NOT f)-quantile_cont(x,0.9) FILTER (WHERE f),4) AS q90_shift FROM v""")
def quantile_shift(shop):
    v = shop.table("lineitem").select((F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("f"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("x"))
    q = ordered.quantiles(v, ["f"], "x", {"m": .5, "q": .9}, width=ordered.UNITS)
    side = lambda c: F.sum(F.when(F.col("f"), -F.col(c)).otherwise(F.col(c)))
    return q.agg(F.round(side("m"), 4).alias("median_shift"), F.round(side("q"), 4).alias("q90_shift"))


@query("e28_positive_evidence", sql("SELECT order_id, candidate, round(score,5) AS score, round(threshold,5) AS threshold, round(score-threshold,5) AS excess FROM flg WHERE flag"))
def positive(shop):
    return rounded(detectors.positive_evidence(flags(shop)), 5)


@query("e29_cohen_kappa", sql("""WITH k AS (SELECT quality AS x, toxic AS y FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE x=y) AS s FROM k), e AS (SELECT sum(a*b) AS c FROM (SELECT x, count(*) AS a FROM k GROUP BY 1) JOIN (SELECT y AS x, count(*) AS b FROM k GROUP BY 1) USING (x))
SELECT n AS cases, round(s/n,6) AS agreement, round(1-(1-s/n)/(1-c/(n*n)),6) AS kappa FROM n, e"""))
def kappa(shop):
    return rounded(evaluation.cohen_kappa(shop.table("labels"), "quality", "toxic"))


define("rate2", "SELECT l_linenumber AS x, CAST(floor(l_discount*100+0.5) AS BIGINT)%7+1 AS y FROM lineitem")


@query("e29_weighted_kappa", sql("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE x=y) AS s, avg((x-y)*(x-y)) AS o FROM rate2), e AS (SELECT sum(a*b*(p-q)*(p-q)) AS c FROM (SELECT x AS p, count(*) AS a FROM rate2 GROUP BY 1), (SELECT y AS q, count(*) AS b FROM rate2 GROUP BY 1))
SELECT n AS cases, round(s/n,6) AS agreement, round(1-o/(c/n/n),6) AS kappa FROM n, e"""))
def weighted_kappa(shop):
    r = shop.table("lineitem").select(F.col("l_linenumber").cast("long").alias("x"), (F.floor(F.col("l_discount") * 100 + 0.5).cast("long") % 7 + 1).alias("y"))
    return rounded(evaluation.cohen_kappa(r, "x", "y", weighted=True))


@query("e29_fleiss_kappa", """WITH r AS (SELECT doc_id AS s, unnest([quality, toxic, CAST(quality>toxic AS INTEGER)]) AS label FROM labels), c AS (SELECT s, label, count(*) AS n FROM r GROUP BY 1,2),
p AS (SELECT s, (sum(n*n)-sum(n))/(sum(n)*(sum(n)-1)) AS p FROM c GROUP BY 1), l AS (SELECT label, sum(n)/(SELECT sum(n) FROM c) AS q FROM c GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS subjects, round((SELECT avg(p) FROM p),6) AS p_bar, round((SELECT sum(q*q) FROM l),6) AS p_e, round(((SELECT avg(p) FROM p)-(SELECT sum(q*q) FROM l))/(1-(SELECT sum(q*q) FROM l)),6) AS fleiss_kappa""")
def fleiss(shop):
    r = shop.table("labels").select(F.col("doc_id").alias("subject"), F.explode(F.array("quality", "toxic", (F.col("quality") > F.col("toxic")).cast("int"))).alias("label"))
    return rounded(evaluation.fleiss_kappa(r))


@query("e30_bootstrap_ci")
def bootstrap(shop):
    return evaluation.bootstrap_kappa(shop.table("labels"), "quality", "toxic")


@query("e33_duration_group_compare", sql("""SELECT flag, count(*) AS rows, round(avg(price_cents),4) AS mean, round(stddev_samp(price_cents),4) AS sd, round(quantile_cont(price_cents::DOUBLE,0.5),4) AS median FROM flg JOIN meas USING (order_id) WHERE candidate='mad_log1p_k25' GROUP BY 1"""))
def group_compare(shop):
    j = flags(shop).where("candidate = 'mad_log1p_k25'").select("order_id", "flag").join(matrix(shop).select("order_id", "price_cents"), "order_id")
    base = j.groupBy("flag").agg(F.count(F.lit(1)).alias("rows"), F.avg("price_cents").alias("mean"), F.stddev_samp("price_cents").alias("sd"))
    return rounded(base.join(ordered.quantiles(j, ["flag"], "price_cents", {"median": .5}, width=ordered.UNITS), "flag"), 4)


_SPREAD = {"p05": .05, "q25": .25, "q75": .75, "p95": .95, "largest": 1.0}


@query("e33_flagged_quantiles", sql("SELECT candidate, flag, count(*) AS rows, " + ", ".join(f"round(quantile_cont(price_cents::DOUBLE,{p}),4) AS {n}" for n, p in _SPREAD.items()) + " FROM flg JOIN (SELECT order_id, price_cents FROM meas) USING (order_id) GROUP BY 1,2"))
def flagged_quantiles(shop):
    j = flags(shop).select("order_id", "candidate", "flag").join(matrix(shop).select("order_id", "price_cents"), "order_id")
    return rounded(ordered.quantiles(j, ["candidate", "flag"], "price_cents", _SPREAD, count="rows", width=ordered.UNITS), 4)


@query("e34_latency_summary", """SELECT event_type, count(*) AS events, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95, round(max(value),6) AS worst FROM events GROUP BY 1""")
def latency(shop):
    e = shop.table("events").withColumn("micro", F.round(F.col("value") * 100).cast("long"))
    q = ordered.quantiles(e, ["event_type"], "micro", {"p50": .5, "p95": .95, "worst": 1.0}, scale=100.0, count="events", width=ordered.UNITS)
    return rounded(q)


@query("f15_interval_metrics", sql("""SELECT role, round(avg(abs(y-m)),5) AS absolute_error, round(avg(greatest(0.05*(y-l),-0.95*(y-l))),5) AS pinball_05, round(avg(greatest(0.95*(y-h),-0.05*(y-h))),5) AS pinball_95,
 round(avg((h-l)+20*greatest(l-y,0)+20*greatest(y-h,0)),4) AS interval_score, round(avg(CAST(y BETWEEN l AND h AS INT)),6) AS covered, round(avg(h-l),5) AS width FROM (SELECT role, quantity::DOUBLE AS y, 10.0 AS l, 90.0 AS m, 200.0 AS h FROM meas) GROUP BY 1"""))
def interval_metrics(shop):
    m = evaluation.interval_metrics(F.col("quantity").cast("double"), F.lit(10.0), F.lit(90.0), F.lit(200.0))
    return matrix(shop).groupBy("role").agg(*[F.round(F.avg(e), 4 if n == "interval_score" else 6 if n == "covered" else 5).alias(n) for n, e in m.items()])


@query("f16_capped_error_bounds", sql("""SELECT role, round(sum(CASE WHEN y IS NULL THEN 0 ELSE abs(least(y,100)-p) END),4) AS lower_error, round(sum(CASE WHEN y IS NULL THEN greatest(p,100-p) ELSE abs(least(y,100)-p) END),4) AS upper_error
 FROM (SELECT role, CASE WHEN raw_status='F' THEN quantity::DOUBLE END AS y, least(discount_points*4.0::DOUBLE,100.0::DOUBLE) AS p FROM meas) GROUP BY 1"""))
def capped(shop):
    low, high = evaluation.capped_error_bounds(F.when(F.col("raw_status") == "F", F.col("quantity").cast("double")), F.col("discount_points") * 4.0, 100)
    return matrix(shop).groupBy("role").agg(F.round(F.sum(low), 4).alias("lower_error"), F.round(F.sum(high), 4).alias("upper_error"))


@query("e21_paired_model_difference", sql("""WITH e AS (SELECT order_id, abs(quantity-90.0) AS l, abs(quantity-discount_points*4.0) AS r FROM meas) SELECT count(*) AS orders, round(avg(l-r),5) AS mean_difference, count(*) FILTER (WHERE l<r) AS left_better, count(*) FILTER (WHERE l>r) AS right_better, count(*) FILTER (WHERE l=r) AS equal FROM e"""))
def paired(shop):
    m = matrix(shop).select("order_id", F.expr("stack(2, 'constant', abs(quantity - 90.0D), 'discount', abs(quantity - discount_points * 4.0D)) AS (model, error)"))
    return rounded(evaluation.paired_difference(m, "constant", "discount"), 5)


@query("e25_wasserstein_1d", sql("""WITH t AS (SELECT raw_status, discount_points AS x, count(*) FILTER (WHERE role='fit') AS a, count(*) FILTER (WHERE role<>'fit') AS b FROM meas GROUP BY 1,2),
c AS (SELECT *, sum(a) OVER w/sum(a) OVER g AS fa, sum(b) OVER w/sum(b) OVER g AS fb, lead(x) OVER w AS nx FROM t WINDOW w AS (PARTITION BY raw_status ORDER BY x), g AS (PARTITION BY raw_status))
SELECT raw_status, round(sum(abs(fa-fb)*(nx-x)),6) AS wasserstein FROM c GROUP BY 1"""))
def wasserstein(shop):
    out = evaluation.ks_and_wasserstein(matrix(shop), ["raw_status"], "discount_points", F.col("role") == "fit", width=ordered.UNITS)
    return rounded(out.select("raw_status", "wasserstein"))
