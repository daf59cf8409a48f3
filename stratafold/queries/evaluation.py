"""Registered queries: ranking metrics, held-out evaluation, sampling, orders and set operations."""

from pyspark.sql import functions as F

from stratafold import fixtures as fx
from stratafold.functions.ordered import exact_percentiles
from stratafold.functions.scalars import region_rank
from stratafold.operators import metrics
from stratafold.plans import evaluation as ev
from stratafold.queries.aggregates import r
from stratafold.registry import query

C = F.col

RANKED = """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY bird ORDER BY probability DESC, doc_id) AS rank,
  sum(label) OVER (PARTITION BY bird ORDER BY probability DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp, sum(label) OVER (PARTITION BY bird) AS pos FROM scored),
m AS (SELECT *, tp / CAST(rank AS DOUBLE) AS p, tp / CAST(greatest(pos, 1) AS DOUBLE) AS rec, 2 * (tp / CAST(rank AS DOUBLE)) * (tp / CAST(greatest(pos, 1) AS DOUBLE)) /
  (tp / CAST(rank AS DOUBLE) + tp / CAST(greatest(pos, 1) AS DOUBLE) + 1e-9::DOUBLE) AS f1 FROM k),
s AS (SELECT bird, count(*) AS n, CAST(max(pos) AS BIGINT) AS positives, sum(p) FILTER (label = 1) / max(pos) AS ap, arg_max(probability, (f1, -rank)) AS threshold, max(f1) AS f1 FROM m GROUP BY bird HAVING max(pos) > 0)
"""


@query("precision_recall_a31", "scored", RANKED + "SELECT doc_id, bird, rank, CAST(tp AS BIGINT) AS tp, round(p, 6) AS precision, round(rec, 6) AS recall FROM m")
def precision_recall(spark, folder):
    return metrics.ranking(fx.scored(spark, folder), "bird", "doc_id").select("doc_id", "bird", "rank", "tp", r("precision", "precision"), r("recall", "recall"))


@query("average_precision_a31", "scored", RANKED + "SELECT bird, n, positives, round(ap, 6) AS average_precision, round(f1, 6) AS f1, round(threshold, 6) AS threshold FROM s")
def average_precision(spark, folder):
    return metrics.ranking_summary(fx.scored(spark, folder), "bird", "doc_id").select("bird", "n", "positives", r("average_precision", "average_precision"), r("f1", "f1"), r("threshold", "threshold"))


@query("held_out_evaluation_m3", "scored", RANKED + "SELECT count(*) AS groups, round(avg(ap), 6) AS mean_ap, round(avg(threshold), 6) AS threshold FROM s")
def held_out_evaluation(spark, folder):
    return metrics.held_out_mean(metrics.ranking_summary(fx.scored(spark, folder), "bird", "doc_id")).select("groups", r("mean_ap", "mean_ap"), r("threshold", "threshold"))


@query("ensemble_a32", "", """
WITH m AS (SELECT vec_id, c.i AS class, avg(CAST(embedding[m.i * 16 + c.i + 1] AS DOUBLE)) AS p FROM embeddings, range(0, 16) c(i), range(0, 4) m(i) GROUP BY 1, 2)
SELECT vec_id, arg_max(class, (p, -class)) AS class, round(max(p), 6) AS p FROM m GROUP BY vec_id""")
def ensemble(spark, folder):
    e = fx.table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select(
        "vec_id", (C("pos") % 16).cast("long").alias("class"), C("v").cast("double").alias("p"))
    return metrics.ensemble(e, "vec_id", "class", "p").select("vec_id", "class", r("p", "p"))


@query("member_agreement_a32", "framed", """
WITH n AS (SELECT image, count(*) FILTER (tissue AND green >= 0.05::DOUBLE) / greatest(count(*) FILTER (tissue OR green >= 0.05::DOUBLE), 1) AS ab,
  count(*) FILTER (tissue AND across > 0) / greatest(count(*) FILTER (tissue OR across > 0), 1) AS ac, count(*) FILTER (green >= 0.05::DOUBLE AND across > 0) / greatest(count(*) FILTER (green >= 0.05::DOUBLE OR across > 0), 1) AS bc FROM framed GROUP BY image)
SELECT image, round((ab + ac + bc) / 3, 6) AS agreement FROM n""")
def member_agreement(spark, folder):
    f = fx.framed(spark, folder).withColumn("a", C("tissue")).withColumn("b", C("green") >= 0.05).withColumn("c", C("across") > 0)
    return metrics.pairwise_agreement(f, ["a", "b", "c"], "image").select("image", r("agreement", "agreement"))


SETTINGS = (0.0, 0.05, 0.1, 0.15, -0.1)
SWEEP = "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('t{i}', {i}, {t}::DOUBLE)" for i, t in enumerate(SETTINGS)) + """) v(setting, position, level)),
s AS (SELECT image, any_value(bird) AS bird, setting, position, count(*) FILTER (green >= level AND lab = 1) / greatest(count(*) FILTER (green >= level OR lab = 1), 1) AS iou FROM framed, t GROUP BY image, setting, position)
"""


def _sweep(spark, folder):
    return ev.sweep(fx.framed(spark, folder), C("lab") == 1, {f"t{i}": C("green") >= t for i, t in enumerate(SETTINGS)}, "image", "bird")


@query("parameter_sweep_a38", "framed", SWEEP + """SELECT setting, round(avg(iou), 6) AS mean, round(quantile_cont(iou, 0.5), 6) AS median,
  round(avg(iou) - (SELECT avg(iou) FROM s WHERE setting = 't0'), 6) AS gain, count(*) AS n FROM s GROUP BY setting""")
def parameter_sweep(spark, folder):
    return ev.sweep_summary(_sweep(spark, folder), "t0").select("setting", r("mean", "mean"), r("median", "median"), r("gain", "gain"), "n")


@query("honest_choice_a21", "framed", SWEEP + """, folds AS (SELECT DISTINCT bird AS held FROM s), m AS (SELECT held, setting, position, round(avg(iou), 10) AS mean FROM folds JOIN s ON s.bird <> held GROUP BY ALL),
pick AS (SELECT held, arg_max(setting, (mean, -position)) AS setting FROM m GROUP BY held)
SELECT held AS bird, p.setting, round(avg(s.iou), 6) AS held_out, count(*) AS n FROM pick p JOIN s ON s.bird = p.held AND s.setting = p.setting GROUP BY ALL""")
def honest_choice(spark, folder):
    return metrics.honest_choice(_sweep(spark, folder), "bird", "setting", "iou", "position").select("bird", "setting", r("held_out", "held_out"), "n")


@query("scoreable_labels_m1", "scored", """
SELECT bird, label, count(*) AS n, count(*) FILTER (source IN ('src1', 'src2', 'src3') OR label = 0) AS scoreable FROM scored GROUP BY bird, label""")
def scoreable_labels(spark, folder):
    checked = ev.refuse_test_rows(fx.scored(spark, folder).withColumn("from_test_grid", C("doc_id") < 0))
    return ev.scoreable(checked, ("src1", "src2", "src3")).groupBy("bird", "label").agg(F.count("*").alias("n"), F.count_if("scoreable").alias("scoreable"))


@query("hard_negatives_m2", "scored", """
WITH c AS (SELECT *, CAST(label = 1 AND doc_id % 40 = 1 AS INT) AS lab FROM scored), z AS (SELECT least(count(*) FILTER (lab = 0), count(*) FILTER (lab = 1) * 20) AS budget FROM c),
h AS (SELECT budget, CAST(round_even(budget * 0.5::DOUBLE, 0) AS BIGINT) AS hard FROM z),
n AS (SELECT doc_id, probability, doc_id * 7919 % 10007 AS draw, row_number() OVER (ORDER BY probability DESC, doc_id) AS rank FROM c WHERE lab = 0),
p AS (SELECT *, CASE WHEN rank <= 2 * hard THEN 'hard' ELSE 'easier' END AS part FROM n, h), d AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY draw, doc_id) AS at_ FROM p)
SELECT doc_id, part, probability FROM d WHERE at_ <= CASE WHEN part = 'hard' THEN hard ELSE budget - hard END""")
def hard_negatives(spark, folder):
    rare = ((C("label") == 1) & (C("doc_id") % 40 == 1)).cast("int")
    return ev.negative_sample(fx.scored(spark, folder).withColumn("label", rare), "doc_id", C("doc_id") * 7919 % 10007)


@query("folds_to_run_m4", "", """
SELECT DISTINCT o_custkey AS fold, o_orderpriority AS settings FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_custkey = orders.o_custkey AND d.o_orderpriority = orders.o_orderpriority)""")
def folds_to_run(spark, folder):
    o = fx.table(spark, folder, "orders").select(C("o_custkey").alias("fold"), C("o_orderpriority").alias("settings"), "o_orderstatus")
    return ev.folds_to_run(o.select("fold", "settings").distinct(), o.filter("o_orderstatus = 'F'"))


@query("least_confident_m5", "cells", """
WITH c AS (SELECT k, quantile_cont(probability, 0.2) AS cut FROM cells WHERE source = 'model' GROUP BY k)
SELECT cells.k, count(*) AS n, round(any_value(cut), 6) AS cut FROM cells JOIN c ON c.k = cells.k WHERE source = 'model' AND probability <= cut GROUP BY cells.k""")
def least_confident(spark, folder):
    c = fx.cells(spark, folder)
    cuts = exact_percentiles(c.filter("source = 'model'"), ["k"], "probability", {"cut": 0.2})
    return ev.least_confident(c, cuts, "k").groupBy("k").agg(F.count("*").alias("n"), r(F.first("cut"), "cut"))


@query("threshold_classes_m6", "cells", """SELECT region, count(*) AS cells, count(*) FILTER (probability >= 0.5::DOUBLE) AS classified, round(min(probability), 6) AS lowest_p FROM cells GROUP BY region""")
def threshold_classes(spark, folder):
    return fx.cells(spark, folder).groupBy("region").agg(F.count("*").alias("cells"), F.count_if(C("probability") >= 0.5).alias("classified"), r(F.min("probability"), "lowest_p"))


@query("canonical_order_o1", "section_areas", "SELECT section_id, region, CASE region WHEN 'dNCM' THEN 0 WHEN 'vNCM' THEN 1 WHEN 'CMM' THEN 2 ELSE 3 END AS region_rank, tissue_px FROM section_areas")
def canonical_order(spark, folder):
    a = fx.section_areas(spark, folder).withColumn("region_rank", region_rank(C("region")))
    return a.orderBy("section_id", "region_rank").select("section_id", "region", "region_rank", "tissue_px")


@query("top_scores_o2", "scored", "SELECT doc_id, round(probability, 6) AS probability FROM (SELECT * FROM scored ORDER BY probability DESC, doc_id LIMIT 50)")
def top_scores(spark, folder):
    """A top-50 report: the limit is the feature. The rows come back in their original order."""
    return fx.scored(spark, folder).orderBy(C("probability").desc(), "doc_id").limit(50).orderBy("doc_id").select("doc_id", r("probability", "probability"))


@query("score_order_o3", "scored", "SELECT doc_id, bird, round(probability, 6) AS probability FROM scored")
def score_order(spark, folder):
    return fx.scored(spark, folder).orderBy(C("probability").desc(), "doc_id").select("doc_id", "bird", r("probability", "probability"))


@query("first_wins_o4", "scored", """SELECT bird, arg_max(doc_id, (label, -doc_id)) AS first_best, min(doc_id) FILTER (label = 0) AS first_negative FROM scored GROUP BY bird""")
def first_wins(spark, folder):
    return fx.scored(spark, folder).groupBy("bird").agg(
        F.max_by("doc_id", F.struct(C("label"), -C("doc_id"))).alias("first_best"), F.min(F.when(C("label") == 0, C("doc_id"))).alias("first_negative"))


@query("set_operations_o5", "cells edits", """
WITH a AS (SELECT DISTINCT k, y, x FROM cells), b AS (SELECT DISTINCT k, y, x FROM edits), u AS (SELECT k, y, x, true AS ina, false AS inb FROM a UNION ALL SELECT k, y, x, false, true FROM b),
g AS (SELECT k, y, x, bool_or(ina) AS ina, bool_or(inb) AS inb FROM u GROUP BY 1, 2, 3)
SELECT k, count(*) FILTER (ina AND NOT inb) AS only_first, count(*) FILTER (inb AND NOT ina) AS only_second, count(*) AS in_union FROM g GROUP BY k""")
def set_operations(spark, folder):
    a = fx.cells(spark, folder).select("k", "y", "x", F.lit(True).alias("a"), F.lit(False).alias("b"))
    b = fx.edits(spark, folder).select("k", "y", "x", F.lit(False).alias("a"), F.lit(True).alias("b"))
    g = a.unionByName(b).groupBy("k", "y", "x").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return g.groupBy("k").agg(F.count_if(C("a") & ~C("b")).alias("only_first"), F.count_if(C("b") & ~C("a")).alias("only_second"), F.count("*").alias("in_union"))
