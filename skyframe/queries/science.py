"""Queries of joins, light curves, arrays, captions and answer parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions import columns as c
from skyframe.functions import text as t
from skyframe.operators import arrays, captions, clean, joins, lightcurves, scoring, splits
from skyframe.queries.base import INPUTS, query

HAV = "degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) * 3600"
NEAR = f"""near AS (SELECT a.object_id AS a_id, b.object_id AS b_id, {HAV} AS sep FROM {{catalog_a}} a JOIN {{catalog_b}} b ON b.dec BETWEEN a.dec - 0.01 AND a.dec + 0.01),
best AS (SELECT * FROM near WHERE sep <= 3 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY sep, b_id) = 1)"""


@query("c1_outer_on_cell", "clean_ids", "supplier", sql="""
WITH a AS (SELECT k, CASE WHEN k % 50 = 0 THEN NULL ELSE k * 2 END AS cell FROM {clean_ids}), b AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 20 = 0 THEN NULL ELSE s_suppkey * 3 END AS cell FROM {supplier})
SELECT coalesce(a.cell, b.cell) AS cell, k, s FROM a FULL OUTER JOIN b ON a.cell IS NOT DISTINCT FROM b.cell""")
def c1(rows: DataFrame, supplier: DataFrame) -> DataFrame:
    a = rows.select("k", F.when(F.col("k") % 50 == 0, None).otherwise(F.col("k") * 2).alias("cell"))
    b = supplier.select(F.col("s_suppkey").alias("s"), F.when(F.col("s_suppkey") % 20 == 0, None).otherwise(F.col("s_suppkey") * 3).alias("cell"))
    return joins.outer_on_cell(a, b, "cell").select("cell", "k", "s")


@query("c2_outer_on_object", "catalog_a", "supplier", sql="SELECT coalesce(object_id, CAST(s_suppkey AS VARCHAR)) AS object_id, survey, s_acctbal FROM {catalog_a} FULL OUTER JOIN {supplier} ON object_id = CAST(s_suppkey * 5 AS VARCHAR)".replace("coalesce(object_id, CAST(s_suppkey AS VARCHAR))", "coalesce(object_id, CAST(s_suppkey * 5 AS VARCHAR))"))
def c2(catalog: DataFrame, supplier: DataFrame) -> DataFrame:
    b = supplier.select((F.col("s_suppkey") * 5).alias("object_id"), "s_acctbal")
    return joins.outer_on_object(catalog.select("object_id", "survey"), b)


@query("c3_crossmatch", "catalog_a", "catalog_b", sql=f"""
WITH {NEAR} SELECT a.object_id, best.b_id AS object_id_right, round(sep, 6) AS sep_arcsec FROM {{catalog_a}} a LEFT JOIN best ON a.object_id = a_id
UNION ALL SELECT NULL, object_id, NULL FROM {{catalog_b}} WHERE object_id NOT IN (SELECT b_id FROM best)""")
def c3(a: DataFrame, b: DataFrame) -> DataFrame:
    out = joins.crossmatch(a.select("object_id", "ra", "dec"), b.select("object_id", "ra", "dec"), 3.0)
    return out.select("object_id", "object_id_right", F.round("sep_arcsec", 6).alias("sep_arcsec"))


@query("c4_attach_nearest", "catalog_a", "catalog_b", sql=f"""
WITH near AS (SELECT a.object_id AS a_id, b.object_id AS b_id, {HAV} AS sep FROM {{catalog_a}} a CROSS JOIN {{catalog_b}} b),
best AS (SELECT a_id, min(sep) AS sep, arg_min(b_id, struct_pack(s := sep, b := b_id)) AS b_id FROM near GROUP BY a_id)
SELECT a.object_id, round(sep, 4) AS sep_arcsec, coalesce(sep <= 2, false) AS crossmatched, CASE WHEN sep <= 2 THEN b.vote END AS vote, CASE WHEN sep <= 2 THEN b.vote_mask ELSE true END AS vote_mask
FROM {{catalog_a}} a LEFT JOIN best ON a.object_id = a_id LEFT JOIN {{catalog_b}} b ON b.object_id = b_id""")
def c4(a: DataFrame, b: DataFrame) -> DataFrame:
    return joins.attach_nearest(a, b, 2.0, ["vote"], ["vote_mask"]).withColumn("sep_arcsec", F.round("sep_arcsec", 4))


@query("c5_append_disjoint", "catalog_a", "catalog_b", sql="SELECT object_id, survey, CAST(NULL AS DOUBLE) AS vote FROM {catalog_a} UNION ALL SELECT object_id, NULL, vote FROM {catalog_b}")
def c5(a: DataFrame, b: DataFrame) -> DataFrame:
    return joins.append_disjoint(a.select("object_id", "survey"), b.select("object_id", "vote"))


@query("c6_translate_ids", "orders", "customer", sql="""
WITH m AS (SELECT o_custkey AS k, arg_max(o_orderkey, o_orderkey) AS target FROM {orders} GROUP BY 1) SELECT target, c_mktsegment AS caption FROM {customer} JOIN m ON c_custkey = k""")
def c6(orders: DataFrame, customer: DataFrame) -> DataFrame:
    mapping = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("target"), F.col("o_orderkey").alias("at"))
    return joins.translate_ids(customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("caption")), mapping, "k", "target", "at").select("target", "caption")


@query("c6_unmatched", "orders", "customer", sql="SELECT count(*) AS n_captions, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM {orders})) AS n_matched, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})) AS n_unmatched FROM {customer}")
def c6_unmatched(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return joins.translation_report(customer.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k")), "k")


@query("c7_lookup_caption", "catalog_a", "customer", sql="""
SELECT object_id, c_name AS caption FROM {catalog_a} JOIN {customer} ON CAST(c_custkey AS VARCHAR) = coalesce(CASE WHEN seq % 3 = 0 THEN CAST(seq + 1 AS VARCHAR) END, object_id)""")
def c7(catalog: DataFrame, customer: DataFrame) -> DataFrame:
    manifest = catalog.select("object_id", F.when(F.col("seq") % 3 == 0, (F.col("seq") + 1).cast("string")).alias("legacy"))
    return joins.lookup_caption(manifest, customer.select(F.col("c_custkey").cast("string").alias("object_id"), F.col("c_name").alias("caption")), "legacy").select("object_id", "caption")


@query("c8_attach_captions", "predictions", "customer", sql="SELECT sample_id, truth, c_name AS caption FROM {predictions} JOIN {customer} ON sample_id = CAST(c_custkey AS VARCHAR)")
def c8(rows: DataFrame, customer: DataFrame) -> DataFrame:
    return joins.attach_captions(rows.select("sample_id", "truth"), customer.select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_name").alias("caption")))


@query("c9_pair_predictions", "predictions", sql="SELECT sample_id, predicted AS predicted_base, predicted_b AS predicted_treatment FROM {predictions}")
def c9(rows: DataFrame) -> DataFrame:
    return joins.pair_predictions(rows, rows.select("sample_id", F.col("predicted_b").alias("predicted")), "sample_id", ["predicted"])


@query("c10_join_modalities", "lineitem", "orders", sql="SELECT l_orderkey AS k, l_linenumber % 3 AS m, l_quantity AS v, o_totalprice AS v_image FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey AND l_linenumber % 3 = o_custkey % 3")
def c10(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    a = lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).cast("long").alias("m"), F.col("l_quantity").alias("v"))
    b = orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).alias("m"), F.col("o_totalprice").alias("v"))
    return joins.join_modalities(a, b, ["k", "m"], "_image").withColumn("m", F.col("m").cast("int"))


@query("c11_align_to", "customer", "catalog_a", sql="SELECT object_id, CAST(seq * 7 % 1000 AS BIGINT) AS position, survey FROM {catalog_a} WHERE seq % 4 = 0")
def c11(customer: DataFrame, catalog: DataFrame) -> DataFrame:
    sample = customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("object_id"), (F.col("c_custkey") * 7 % 1000).alias("position"))
    return joins.align_to(sample, catalog.select("object_id", "survey"), "object_id", "position")


@query("c12_pending", "customer", "orders", sql="SELECT c_custkey AS k FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F')")
def c12(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return joins.pending(customer.select(F.col("c_custkey").alias("k")), orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k")


GAPS = """g AS (SELECT object_id, row_number() OVER w - 1 AS gap_pos, lag(mjd) OVER w AS a, mjd AS b FROM {points} WHERE used WINDOW w AS (PARTITION BY object_id ORDER BY mjd, pos)),
cl AS (SELECT object_id, pos AS claim_pos, CASE WHEN pos % 5 <> 0 THEN mjd - 3 END AS s, CASE WHEN pos % 7 <> 0 THEN mjd + 4 END AS e, CASE WHEN pos % 3 = 0 THEN 5e0 END AS d FROM {points} WHERE NOT used)"""


@query("c13_match_gap", "points", sql=f"""
WITH {GAPS}, m AS (SELECT cl.object_id, claim_pos, s - a AS se, e - b AS ee, gap_pos FROM cl JOIN g USING (object_id) WHERE a IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY cl.object_id, claim_pos ORDER BY abs(a - s) + abs(b - e), gap_pos) = 1)
SELECT cl.object_id, claim_pos, CASE WHEN gap_pos IS NOT NULL THEN 'matched' WHEN s IS NOT NULL AND e IS NOT NULL THEN 'no_gap' WHEN d IS NOT NULL THEN 'duration_only' ELSE 'no_numbers' END AS status, round(se, 6) AS start_error, round(ee, 6) AS end_error
FROM cl LEFT JOIN m USING (object_id, claim_pos)""")
def c13(points: DataFrame) -> DataFrame:
    g = splits.gaps(points.where("used"), "object_id", "mjd", "pos")
    when = lambda cond, v: F.when(F.expr(cond), v)
    claims = points.where("NOT used").select("object_id", F.col("pos").alias("claim_pos"), when("pos % 5 <> 0", F.col("mjd") - 3).alias("start_days"), when("pos % 7 <> 0", F.col("mjd") + 4).alias("end_days"), when("pos % 3 = 0", F.lit(5.0)).alias("duration_days"))
    out = joins.match_gap(claims, g)
    return out.select("object_id", "claim_pos", "status", F.round("start_error", 6).alias("start_error"), F.round("end_error", 6).alias("end_error"))


PEAKS = """z AS (SELECT object_id, min(mjd) AS t0 FROM {points} WHERE used GROUP BY 1),
pk AS (SELECT p.object_id, CASE WHEN band_id = 1 THEN 'g' ELSE 'r' END AS band, mjd - t0 AS t, CASE WHEN flux <> 0 THEN 27.5 - 2.5 * log10(abs(flux)) END AS mag FROM {points} p JOIN z USING (object_id) WHERE used QUALIFY row_number() OVER (PARTITION BY p.object_id, band_id ORDER BY flux DESC, mjd, pos) = 1)"""


@query("c14_match_peak", "points", sql=f"""
WITH {PEAKS}, cl AS (SELECT object_id, pos AS claim_pos, CASE pos % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'r' ELSE 'i' END AS band, mjd / 10 AS td, 20e0 AS mg FROM {{points}} WHERE NOT used)
SELECT cl.object_id, claim_pos, cl.band, CASE WHEN t IS NULL THEN 'band_absent' ELSE 'matched' END AS status, round(td - t, 6) AS time_error, round(mg - mag, 6) AS magnitude_error FROM cl LEFT JOIN pk ON pk.object_id = cl.object_id AND pk.band = cl.band""")
def c14(points: DataFrame) -> DataFrame:
    band = F.when(F.col("pos") % 3 == 0, "g").when(F.col("pos") % 3 == 1, "r").otherwise("i")
    claims = points.where("NOT used").select("object_id", F.col("pos").alias("claim_pos"), band.alias("band"), (F.col("mjd") / 10).alias("time_days"), F.lit(20.0).alias("magnitude"))
    out = joins.match_peak(claims, lightcurves.peak_facts(points))
    return out.select("object_id", "claim_pos", "band", "status", F.round("time_error", 6).alias("time_error"), F.round("magnitude_error", 6).alias("magnitude_error"))


@query("c15_closest_observation", "orders", sql="""
SELECT o_custkey, o_orderkey FROM {orders} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END ASC NULLS LAST, o_orderkey) = 1""")
def c15(orders: DataFrame) -> DataFrame:
    d = orders.withColumn("d", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))
    return joins.closest_observation(d, "o_custkey", "d", "o_orderkey").select("o_custkey", "o_orderkey")


@query("c16_swap_donors", "objects", sql="""
WITH p AS (SELECT object_id, lang_ AS g, row_number() OVER (PARTITION BY lang_ ORDER BY sha256(concat('9:', object_id)), object_id) - 1 AS i, count(*) OVER (PARTITION BY lang_) AS n FROM (SELECT object_id, coalesce(survey, 'none') AS lang_ FROM {objects}))
SELECT a.object_id, b.object_id AS donor FROM p a JOIN p b ON a.g = b.g AND b.i = (a.i + 1 + 9 % greatest(a.n - 1, 1)) % a.n WHERE a.n > 1""")
def c16(objects: DataFrame) -> DataFrame:
    return joins.swap_donors(objects.select("object_id", F.coalesce("survey", F.lit("none")).alias("g")), "object_id", "g", 9)


@query("c17_line_coverage", "catalog_a", sql=f"""
WITH l AS (SELECT * FROM (VALUES {", ".join(f"('{name}', {rest})" for name, rest in joins.REST_LINES)}) AS t(line, rest))
SELECT object_id, line, round(CAST(rest AS DOUBLE) * (1 + dist), 6) AS observed FROM {{catalog_a}}, l WHERE CAST(rest AS DOUBLE) * (1 + dist) BETWEEN 4000 + seq % 1000 AND 8000""")
def c17(catalog: DataFrame) -> DataFrame:
    rows = catalog.select("object_id", F.col("dist").alias("z"), (4000 + F.col("seq") % 1000).cast("double").alias("low"), F.lit(8000.0).alias("high"))
    return joins.line_coverage(rows, "object_id", "z", "low", "high").withColumn("observed", F.round("observed", 6))


@query("c18_ground_truth", "orders", "lineitem", sql="""
WITH l AS (SELECT l_orderkey AS k, string_agg(l_returnflag || l_linestatus || l_linenumber, '|' ORDER BY l_extendedprice DESC, l_returnflag || l_linestatus || l_linenumber) AS lines FROM {lineitem} GROUP BY 1)
SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN 'Quasar' ELSE o_orderstatus END AS class, o_orderpriority AS subclass, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(lines, '') END AS lines FROM {orders} LEFT JOIN l ON k = o_orderkey""")
def c18(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    df = orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "DESI").otherwise("SDSS").alias("survey"))
    types = orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "O", "QSO").otherwise(F.col("o_orderstatus")).alias("class"), F.col("o_orderpriority").alias("subclass"))
    lines = lineitem.select(F.col("l_orderkey").alias("k"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("label"), F.col("l_extendedprice").alias("snr"))
    return joins.attach_ground_truth(df, types, lines, "k").select("k", "class", "subclass", F.array_join("lines", "|").alias("lines"))


@query("c19_combine_sides", "predictions", sql="SELECT sample_id, truth AS base_answer, coalesce(predicted, 'none') AS equipped_answer FROM {predictions}")
def c19(rows: DataFrame) -> DataFrame:
    base = rows.select("sample_id", F.col("truth").alias("answer"))
    out = joins.combine_sides(base, rows.select("sample_id", F.coalesce("predicted", F.lit("none")).alias("answer")), "sample_id", ["answer"])
    return out.select("sample_id", F.col("base.answer").alias("base_answer"), F.col("equipped.answer").alias("equipped_answer"))


# --- light curves -------------------------------------------------------------------------------------------------------

#: Some errors are NaN or zero: such points are no detections.
INPUTS["odd_points"] = "SELECT object_id, pos, mjd, flux, CASE WHEN pos % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN pos % 17 = 1 THEN 0e0 ELSE err END AS err, band_id, used FROM {points}"
WINDOWED = """d AS (SELECT *, CASE WHEN err > 0 AND NOT isnan(err) AND flux / err > 5 THEN mjd END AS hit FROM {odd_points} WHERE used), w AS (SELECT *, min(hit) OVER (PARTITION BY object_id) AS f, max(hit) OVER (PARTITION BY object_id) AS l FROM d),
k AS (SELECT * FROM w WHERE f IS NULL OR mjd BETWEEN f - 30 AND l), cap AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY sha256(concat('42:', object_id, ':', CAST(pos AS VARCHAR))), pos) <= 40)"""


@query("b23_prepare_lightcurve", "odd_points", sql=f"""
WITH {WINDOWED} SELECT object_id, pos, CAST(row_number() OVER o AS INT) AS rank, round(mjd - first_value(mjd) OVER o, 6) AS t FROM cap WINDOW o AS (PARTITION BY object_id ORDER BY mjd, pos)""")
def b23(points: DataFrame) -> DataFrame:
    return lightcurves.prepare_points(points, 40).select("object_id", "pos", "rank", F.round("t", 6).alias("t"))


@query("b24_retained_points", "points", sql="SELECT object_id, pos, mjd FROM {points} WHERE used")
def b24(points: DataFrame) -> DataFrame:
    return lightcurves.retained(points).select("object_id", "pos", "mjd")


@query("d21_table_facts", "points", sql="SELECT object_id, count(*) AS n, round(max(mjd) - min(mjd), 6) AS span FROM {points} WHERE used GROUP BY 1")
def d21(points: DataFrame) -> DataFrame:
    return lightcurves.table_facts(points).withColumn("span", F.round("span", 6))


@query("d21_peaks", "points", sql=f"WITH {PEAKS} SELECT object_id, band, round(t, 6) AS peak_time, round(mag, 6) AS peak_mag FROM pk")
def d21_peaks(points: DataFrame) -> DataFrame:
    return lightcurves.peak_facts(points).withColumn("peak_time", F.round("peak_time", 6)).withColumn("peak_mag", F.round("peak_mag", 6))


@query("d22_photometry_summary", "points", sql="""
WITH z AS (SELECT *, mjd - min(mjd) OVER (PARTITION BY object_id) AS t FROM {points} WHERE used), s AS (SELECT *, lag(t) OVER (PARTITION BY object_id ORDER BY mjd, pos) AS before FROM z),
b AS (SELECT object_id, band_id, 27.5 - 2.5 * log10(flux) AS mag, err * (2.5 / ln(10)) / flux AS error, t FROM z WHERE flux > 0 QUALIFY row_number() OVER (PARTITION BY object_id, band_id ORDER BY 27.5 - 2.5 * log10(flux), t) = 1),
gap AS (SELECT object_id, t - before AS size, before, t FROM s WHERE before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY t - before DESC, before DESC) = 1),
n AS (SELECT object_id, max(t) AS baseline, count(*) FILTER (WHERE band_id = 1) AS n_g, count(*) FILTER (WHERE band_id = 2) AS n_r FROM z GROUP BY 1)
SELECT n.object_id, round(baseline, 6) AS baseline, n_g, n_r, round(coalesce(size, 0), 6) AS largest_gap, round(coalesce(gap.before, 0), 6) AS gap_start, round(coalesce(gap.t, 0), 6) AS gap_end,
round(g.mag, 6) AS mag_g, round(g.error, 6) AS error_g, round(g.t, 6) AS day_g, round(r.mag, 6) AS mag_r, round(r.error, 6) AS error_r, round(r.t, 6) AS day_r
FROM n LEFT JOIN gap USING (object_id) LEFT JOIN b g ON g.object_id = n.object_id AND g.band_id = 1 LEFT JOIN b r ON r.object_id = n.object_id AND r.band_id = 2""")
def d22(points: DataFrame) -> DataFrame:
    out = lightcurves.photometry_summary(points)
    rounded = [c for c in out.columns if c not in ("object_id", "n_g", "n_r")]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


LINE = "concat_ws(' ', printf('%.5f', mjd - t0), CASE WHEN band_id = 1 THEN 'g' ELSE 'r' END, printf('%.5f', flux), printf('%.5f', err), CASE WHEN flux <> 0 THEN printf('%.5f', 27.5 - 2.5 * log10(abs(flux))) ELSE 'nan' END, CASE WHEN flux <> 0 THEN printf('%.5f', err * (2.5 / ln(10)) / abs(flux)) ELSE 'nan' END)"


def _mag(c: str) -> str:
    return f"CASE WHEN flux <> 0 THEN printf('%.6f', {c}) ELSE 'nan' END"


@query("g17_render_table", "points", sql=f"""
WITH p AS (SELECT object_id, pos, mjd - min(mjd) OVER (PARTITION BY object_id) AS t, mjd, band_id, flux, err FROM {{points}} WHERE used)
SELECT object_id, concat('TIME_DAYS BAND FLUXCAL FLUXCAL_ERR DIFF_MAG DIFF_MAG_ERR', chr(10), string_agg(concat_ws(' ', printf('%.6f', t), CASE WHEN band_id = 1 THEN 'g' ELSE 'r' END, printf('%.6f', flux), printf('%.6f', err),
{_mag('27.5e0 - 2.5e0 * log10(abs(flux))')}, {_mag('err * (2.5e0 / ln(10e0)) / abs(flux)')}), chr(10) ORDER BY mjd, pos)) AS table_text FROM p GROUP BY 1""")
def g17(points: DataFrame) -> DataFrame:
    return lightcurves.render_table(points, decimals=6).select("object_id", F.col("table").alias("table_text"))


@query("g18_parse_table", "points", sql="""
SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY mjd, pos) - 1 AS INT) AS pos, CASE WHEN band_id = 1 THEN 'g' ELSE 'r' END AS band, round(flux, 5) AS flux, round(err, 5) AS err, true AS ok FROM {points} WHERE used""")
def g18(points: DataFrame) -> DataFrame:
    return lightcurves.parse_table(lightcurves.render_table(points), "object_id", "table").select("object_id", "pos", "band", F.round("flux", 5).alias("flux"), F.round("err", 5).alias("err"), "ok")


@query("g26_score_spans", "points", sql="""
SELECT object_id, round(abs(100 - (max(mjd) - min(mjd))), 6) AS abs_error, round(abs(100 - (max(mjd) - min(mjd))) / nullif(max(mjd) - min(mjd), 0), 6) AS rel_error FROM {points} WHERE used GROUP BY 1""")
def g26(points: DataFrame) -> DataFrame:
    claims = points.select("object_id").distinct().withColumn("duration", F.lit(100.0))
    out = lightcurves.score_spans(claims, lightcurves.table_facts(points))
    return out.select("object_id", F.round("abs_error", 6).alias("abs_error"), F.round("rel_error", 6).alias("rel_error"))


@query("d18_claim_error_summary", "points", sql="""
WITH e AS (SELECT 'flux' AS metric, abs(flux) AS v FROM {points} UNION ALL SELECT 'late', abs(CASE WHEN pos % 3 = 0 THEN mjd END) FROM {points})
SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 FROM e WHERE v IS NOT NULL GROUP BY metric""")
def d18(points: DataFrame) -> DataFrame:
    return lightcurves.claim_error_summary(points.select("flux", F.when(F.col("pos") % 3 == 0, F.col("mjd")).alias("late")), ["flux", "late"])


@query("d28_claim_validation", "lineitem", "orders", sql="""
WITH e AS (SELECT l_orderkey AS k, l_returnflag AS kind, count(*) AS n FROM {lineitem} GROUP BY ALL), r AS (SELECT o_orderkey AS k, unnest(['A', 'N']) AS kind, 2 AS n FROM {orders})
SELECT kind, CAST(sum(coalesce(e.n, 0)) AS BIGINT) AS n_extracted, CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS n_reviewed, count(*) FILTER (WHERE coalesce(e.n, 0) = coalesce(r.n, 0)) AS n_equal FROM e FULL OUTER JOIN r USING (k, kind) GROUP BY kind""")
def d28(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    e = lineitem.groupBy(F.col("l_orderkey").alias("object_id"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    r = orders.select(F.col("o_orderkey").alias("object_id"), F.explode(F.array(F.lit("A"), F.lit("N"))).alias("kind"), F.lit(2).alias("n"))
    return lightcurves.claim_validation_totals(e, r)


# --- arrays -------------------------------------------------------------------------------------------------------------


def _spectra(arr: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", "wave", "flux", "ivar", "masked")))
    return arr.groupBy("object_id").agg(rows.alias("r")).select("object_id", *[F.col(f"r.{f}").alias(f) for f in ("wave", "flux", "ivar", "masked")])


@query("b18_select_bands", "lineitem", sql="SELECT l_orderkey, l_linenumber, concat_ws('|', printf('%.2f', l_tax), printf('%.2f', CASE WHEN l_linenumber % 4 = 3 THEN l_discount ELSE l_quantity END), printf('%.2f', 0.0)) AS picked FROM {lineitem}")
def b18(lineitem: DataFrame) -> DataFrame:
    image = lambda name, value: F.struct(F.lit(name).alias("band"), value.alias("flux"))
    images = F.array(image("des-G", F.col("l_quantity")), image("des-i", F.lit(0.0)), image("DES_R", F.col("l_tax")))
    # Some have a band twice: the last one counts.
    images = F.when(F.col("l_linenumber") % 4 == 3, F.concat(images, F.array(image(" g ", F.col("l_discount"))))).otherwise(images)
    picked = arrays.select_bands(images, ["r", "des-g", "I"])
    return lineitem.select("l_orderkey", "l_linenumber", F.concat_ws("|", F.transform(picked, lambda x: F.format_string("%.2f", x["flux"]))).alias("picked"))


@query("b19_repair_rows", "embeddings", sql="""
SELECT vec_id, list_transform(range(8), lambda k : CASE WHEN (k + vec_id) % 5 = 0 THEN repeat('nan ', 8) ELSE concat(array_to_string(list_transform(list_slice(embedding, k * 8 + 1, k * 8 + 8), lambda x : printf('%.5f', CAST(x AS DOUBLE))), ' '), ' ') END) AS row_list FROM {embeddings}""".replace("SELECT vec_id, list_transform", "SELECT vec_id, array_to_string(list_transform").replace("END) AS row_list", "END), '/') AS pixels"))
def b19(embeddings: DataFrame) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when((k + F.col("vec_id")) % 5 != 0, F.transform(F.slice("embedding", k * 8 + 1, 8), lambda x: x.cast("double"))))
    shown = lambda x: F.when(F.isnan(x), "nan ").otherwise(F.format_string("%.5f ", x))
    text = F.transform(arrays.repair_rows(rows), lambda r: F.array_join(F.transform(r, shown), ""))
    return embeddings.select("vec_id", F.array_join(text, "/").alias("pixels"))


@query("b20_trim_spectrum", "arr", sql="SELECT object_id, count(*) AS n, round(sum(i * wave), 3) AS weighted FROM (SELECT object_id, wave, row_number() OVER (PARTITION BY object_id ORDER BY wave, pos) AS i FROM {arr} WHERE wave > 0) GROUP BY 1")
def b20(arr: DataFrame) -> DataFrame:
    trimmed = arrays.trim_spectrum(F.col("wave"), F.col("flux"), F.col("ivar"))
    each = _spectra(arr).select("object_id", F.posexplode(trimmed).alias("i", "p"))
    return each.groupBy("object_id").agg(F.count("*").alias("n"), F.round(F.sum((F.col("i") + 1) * F.col("p.wave")), 3).alias("weighted"))


@query("b21_length_bucket", "arr", sql="SELECT bucket, count(*) AS n FROM (SELECT object_id, CAST(count(*) FILTER (WHERE wave > 0) AS INT) AS bucket FROM {arr} GROUP BY 1) GROUP BY 1")
def b21(arr: DataFrame) -> DataFrame:
    return _spectra(arr).groupBy(arrays.length_bucket(F.col("wave")).alias("bucket")).agg(F.count("*").alias("n"))


#: Widths of the grid, by the same rule: an eighth more than the one before, or one more.
GRID = "grid AS (SELECT w FROM (WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS w UNION ALL SELECT greatest(w + 1, CAST(floor(w * 1.125e0) AS BIGINT)) FROM r WHERE w < (SELECT max(greatest(n_chars, 1)) FROM {documents})) SELECT w FROM r))"


@query("b21_token_batches", "documents", sql=f"""
WITH {GRID}, l AS (SELECT greatest(coalesce(n_chars, 1), 1) AS n FROM {{documents}}), top AS (SELECT max(n) AS most FROM l), w AS (SELECT n, least((SELECT min(w) FROM grid WHERE w >= n), most) AS width FROM l, top)
SELECT CAST(width AS INT) AS width, count(*) AS n_rows, CAST(ceil(count(*) / (400000 // width)) AS BIGINT) AS n_batches, CAST(sum(n) AS BIGINT) AS n_used, true AS within, true AS gapless FROM w GROUP BY width""")
def b21_batches(documents: DataFrame) -> DataFrame:
    out = arrays.token_batches(documents.select("doc_id", "n_chars"), F.col("n_chars"), 400_000, "doc_id")
    size = F.greatest(F.col("n_chars"), F.lit(1))
    each = out.groupBy("width", "batch").agg(F.count("*").alias("n"), F.max(size).alias("most"), F.sum(size).alias("used"))
    gapless = (F.max("batch") - F.min("batch") + 1 == F.count("*"))
    return each.groupBy("width").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_batches"), F.sum("used").alias("n_used"), F.bool_and(F.col("n") * F.col("most") <= 400_000).alias("within"), gapless.alias("gapless"))


@query("b21_padding_report", "documents", sql="SELECT count(*) AS n_rows, CAST(sum(greatest(coalesce(n_chars, 1), 1)) AS BIGINT) AS n_used, CAST(0 AS BIGINT) AS n_over, true AS thin, true AS numbered FROM {documents}")
def b21_report(documents: DataFrame) -> DataFrame:
    out = arrays.token_batches(documents.select("doc_id", "n_chars"), F.col("n_chars"), 400_000, "doc_id")
    report = arrays.padding_report(out, F.col("n_chars"), 400_000)
    last = out.agg((F.max("batch") + 1).alias("_last"))
    # The grid bounds padding by an eighth.
    return report.join(last, how="cross").select("n_rows", "n_used", "n_over", (F.col("padding_share") < 0.125).alias("thin"), (F.col("n_batches") == F.col("_last")).alias("numbered"))  # single rows


def _list(column: str, ending: str) -> str:
    return f"array_to_string(list_concat(list_transform(list({column} ORDER BY pos, wave, flux, ivar, masked), lambda x : printf('%.3f', CAST(x AS DOUBLE))), list_transform(range(n - k), lambda i : printf('%.3f', {ending}))), ' ')"


@query("b22_pad_spectra", "arr", sql=f"""
WITH g AS (SELECT object_id, count(*) AS k, list(wave ORDER BY pos, wave, flux, ivar, masked)[-1] AS ending FROM {{arr}} GROUP BY 1), w AS (SELECT *, max(k) OVER (PARTITION BY object_id % 50) AS n FROM g),
a AS (SELECT arr.*, CAST(arr.masked AS INT) AS m, w.n, w.k, w.ending FROM {{arr}} arr JOIN w USING (object_id))
SELECT object_id, {_list('wave', 'ending + (i + 1) * 0.8e0')} AS wave, {_list('flux', '0e0')} AS flux, {_list('ivar', '0e0')} AS ivar, {_list('m', '1e0')} AS mask FROM a GROUP BY object_id, n, k, ending""")
def b22(arr: DataFrame) -> DataFrame:
    padded = arrays.pad_spectra(_spectra(arr).withColumn("batch", F.pmod(F.col("object_id"), F.lit(50))), "batch", "wave", "flux", "ivar", "masked")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.3f", x.cast("double"))), " ").alias(c.replace("masked", "mask"))
    return padded.select("object_id", *[shown(c) for c in ("wave", "flux", "ivar")], F.array_join(F.transform("masked", lambda m: F.when(m, "1.000").otherwise("0.000")), " ").alias("mask"))


@query("b25_subsample", "embeddings", sql="SELECT vec_id, round(list_sum(list_transform(range(10), lambda i : CAST(embedding[CAST(floor(i * 63 / 9) AS BIGINT) + 1] AS DOUBLE))), 5) AS total FROM {embeddings}")
def b25(embeddings: DataFrame) -> DataFrame:
    some = arrays.subsample_linspace(F.transform("embedding", lambda x: x.cast("double")), 10)
    return embeddings.select("vec_id", F.round(F.aggregate(some, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("b26_plot_bounds", "points", sql="""
WITH q AS (SELECT object_id, count(*) AS n_points, quantile_cont(flux, 0.005) AS a, quantile_cont(flux, 0.995) AS b FROM {points} WHERE mjd > 0 AND pos % 29 > 1 AND used GROUP BY 1 HAVING count(*) >= 10)
SELECT object_id, n_points, round(a - 0.08 * greatest(b - a, 1e-4), 6) AS low, round(b + 0.35 * greatest(b - a, 1e-4), 6) AS high FROM q""")
def b26(points: DataFrame) -> DataFrame:
    wave = F.when(F.col("pos") % 29 == 0, float("nan")).when(F.col("pos") % 29 == 1, float("inf")).otherwise(F.col("mjd"))
    out = arrays.plot_bounds(points.withColumn("masked", ~F.col("used")).withColumn("mjd", wave), "object_id", "mjd", "flux", "masked")
    return out.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query("b27_pad_tokens", "embeddings", sql="""
SELECT vec_id, array_to_string(list_transform(range(24), lambda k : printf('%.5f', CASE WHEN k < 4 * least(label + 1, 6) THEN CAST(embedding[k + 1] AS DOUBLE) ELSE 0e0 END)), ' ') AS tokens, array_to_string(list_transform(range(6), lambda k : CASE WHEN k > label THEN 1 ELSE 0 END), '') AS mask FROM {embeddings}""")
def b27(embeddings: DataFrame) -> DataFrame:
    tokens = F.transform(F.sequence(F.lit(0), F.col("label").cast("int")), lambda k: F.transform(F.slice("embedding", k * 4 + 1, 4), lambda x: x.cast("double")))
    p = arrays.pad_tokens(tokens, 6, 4)
    return embeddings.select("vec_id", F.array_join(F.transform(F.flatten(p["tokens"]), lambda x: F.format_string("%.5f", x)), " ").alias("tokens"), F.array_join(F.transform(p["mask"], lambda m: m.cast("int").cast("string")), "").alias("mask"))


@query("b28_spectrum_extent", "arr", "orders", sql="""
WITH w AS (SELECT object_id, min(wave) AS low, max(wave) AS high FROM {arr} GROUP BY 1), o AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM {orders} JOIN w ON object_id = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1)
SELECT o_custkey AS owner, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS z, low, high FROM o JOIN w ON w.object_id = o_orderkey""")
def b28(arr: DataFrame, orders: DataFrame) -> DataFrame:
    rows = _spectra(arr).join(orders.select(F.col("o_orderkey").alias("object_id"), F.col("o_custkey").alias("owner"), F.substring("o_orderpriority", 1, 1).alias("z"), "o_totalprice"), "object_id")
    return arrays.spectrum_extent(rows, "owner", "z", "wave", "o_totalprice", "object_id")


@query("b29_caption_eligibility", "arr", sql="""
SELECT object_id, CASE WHEN object_id % 5 = 0 THEN 'no_quotes' WHEN object_id % 7 = 0 THEN 'no_observation' WHEN object_id % 11 = 0 THEN 'invalid_spectrum' WHEN count(*) FILTER (WHERE wave > 0) < 3 THEN 'too_few_points' ELSE 'eligible' END AS status FROM {arr} GROUP BY object_id""")
def b29(arr: DataFrame) -> DataFrame:
    df = _spectra(arr).withColumn("quotes", F.when(F.col("object_id") % 5 != 0, F.array(F.lit("q")))).withColumn("n_obs", F.when(F.col("object_id") % 7 != 0, 1)).withColumn("n_points", F.when(F.col("object_id") % 11 != 0, F.size(arrays.trim_spectrum(F.col("wave")))))
    return df.select("object_id", clean.caption_eligibility(df, "quotes", "n_obs", "n_points", 3).alias("status"))


@query("g19_spectrum_text", "arr", sql="SELECT object_id, string_agg(printf('%.1f', wave) || ':' || printf('%.3f', flux), ' ' ORDER BY pos, wave, flux) AS text FROM {arr} GROUP BY 1")
def g19(arr: DataFrame) -> DataFrame:
    return _spectra(arr).select("object_id", arrays.spectrum_text(F.col("wave"), F.col("flux"), 100).alias("text"))


@query("d29_half_precision_error", "embeddings", sql="""
WITH x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM {embeddings}), u AS (SELECT x, pow(2, greatest(floor(log2(abs(x))), -14) - 10) AS step FROM x WHERE x <> 0)
SELECT max(abs(x - round_even(x / step, 0) * step)) AS max_error FROM u""")
def d29(embeddings: DataFrame) -> DataFrame:
    return arrays.fp16_error(embeddings, "embedding")


@query("k2_flatten_tokens", "embeddings", sql="SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE), 5) AS ends FROM {embeddings}")
def k2(embeddings: DataFrame) -> DataFrame:
    flat = arrays.flatten_tokens(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)))
    return embeddings.select("vec_id", F.size(flat).alias("n"), F.round(F.get(flat, F.lit(0)).cast("double") + F.get(flat, F.lit(63)).cast("double"), 5).alias("ends"))


# --- captions -----------------------------------------------------------------------------------------------------------

VOCABULARY = {"image": ["the ", "le "], "spectra": ["tion", "cion"], "lightcurve": ["die ", "los "]}
INPUTS["prose"] = "SELECT doc_id, lower(replace(text, chr(10), ' ')) AS text, lang, source FROM {documents}"
SENT = "SELECT doc_id, source, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s : trim(s)), lambda s : s <> '')) AS s, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s : trim(s)), lambda s : s <> ''), 1) - 1 AS i FROM {prose}".replace("\x01", "¦")
CLAIMS = f"""s AS ({SENT}), c AS (SELECT doc_id, source, CAST(i AS INT) AS i, s, concat_ws('+', CASE WHEN contains(s, 'the ') OR contains(s, 'le ') THEN 'image' END, CASE WHEN contains(s, 'die ') OR contains(s, 'los ') THEN 'lightcurve' END, CASE WHEN doc_id % 4 <> 0 AND (contains(s, 'tion') OR contains(s, 'cion')) THEN 'spectra' END) AS support FROM s)"""


def _claims(prose: DataFrame) -> DataFrame:
    have = {"image": F.lit(True), "spectra": F.col("doc_id") % 4 != 0, "lightcurve": F.lit(True)}
    return t.decompose_claims(prose, "doc_id", "text", "source", VOCABULARY, have)


@query("g1_split_sentences", "prose", sql=f"SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM ({SENT}) GROUP BY doc_id")
def g1(prose: DataFrame) -> DataFrame:
    each = prose.select("doc_id", F.explode(t.split_sentences(F.col("text"))).alias("s"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@query("g2_tag_support", "prose", sql=f"WITH {CLAIMS} SELECT support, count(*) AS n FROM c GROUP BY support")
def g2(prose: DataFrame) -> DataFrame:
    have = {"image": F.lit(True), "spectra": F.col("doc_id") % 4 != 0, "lightcurve": F.lit(True)}
    each = prose.select("doc_id", F.explode(t.split_sentences(F.col("text"))).alias("s"))
    return each.groupBy(F.array_join(t.tag_support(F.col("s"), VOCABULARY, have), "+").alias("support")).agg(F.count("*").alias("n"))


@query("g3_decompose_claims", "prose", sql=f"WITH {CLAIMS} SELECT doc_id, i AS claim_pos, support, CASE WHEN contains(support, '+') THEN 'relation' ELSE 'observation' END AS kind, source || '#sent' || i AS provenance FROM c WHERE support <> ''")
def g3(prose: DataFrame) -> DataFrame:
    return _claims(prose).select("doc_id", "claim_pos", F.array_join("supporting", "+").alias("support"), "kind", "provenance")


COMPOSED = """one AS (SELECT doc_id, support AS subset, i, s, support FROM c WHERE support IN ('image', 'spectra', 'lightcurve')), full_ AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'image+lightcurve+spectra' ELSE 'image+lightcurve' END AS subset, i, s, support FROM c WHERE support <> ''), u AS (SELECT * FROM one UNION ALL SELECT * FROM full_)"""


@query("g4_compose_captions", "prose", sql=f"WITH {CLAIMS}, {COMPOSED} SELECT doc_id, subset, sha256(string_agg(s, ' ' ORDER BY i)) AS digest, count(*) AS n_claims FROM u GROUP BY ALL")
def g4(prose: DataFrame) -> DataFrame:
    sets = F.when(F.col("doc_id") % 4 != 0, F.array(F.lit("image"), F.lit("lightcurve"), F.lit("spectra"))).otherwise(F.array(F.lit("image"), F.lit("lightcurve")))
    out = captions.compose_captions(_claims(prose), prose.select("doc_id", sets.alias("subset")), "doc_id")
    return out.select("doc_id", F.array_join("subset", "+").alias("subset"), F.sha2("text", 256).alias("digest"), "n_claims")


@query("g5_assemble_captions", "prose", sql=f"""WITH {CLAIMS}, r AS (SELECT doc_id, i, s, support FROM c WHERE contains(support, '+') UNION ALL SELECT doc_id, -1, concat('lang ', lang), 'image' FROM {{prose}}),
u AS (SELECT doc_id, 'image' AS subset, i, s FROM r WHERE support = 'image' UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'image+lightcurve+spectra' ELSE 'image+lightcurve' END, i, s FROM r)
SELECT doc_id, subset, count(*) AS n_claims, sha256(string_agg(s, ' ' ORDER BY i)) AS digest FROM u GROUP BY ALL""")
def g5(prose: DataFrame) -> DataFrame:
    sets = F.when(F.col("doc_id") % 4 != 0, F.array(F.lit("image"), F.lit("lightcurve"), F.lit("spectra"))).otherwise(F.array(F.lit("image"), F.lit("lightcurve")))
    vetted = prose.select("doc_id", F.concat(F.lit("lang "), "lang").alias("caption"))
    out = captions.assemble_captions(_claims(prose), [("image", vetted)], prose.select("doc_id", sets.alias("subset")), "doc_id")
    return out.select("doc_id", F.array_join("subset", "+").alias("subset"), "n_claims", F.sha2("text", 256).alias("digest"))


@query("d4_caption_report", "prose", sql=f"""WITH {CLAIMS}, {COMPOSED}, k AS (SELECT DISTINCT doc_id, subset FROM u), x AS (SELECT count(*) AS n FROM u WHERE doc_id % 3 = 0 AND contains(support, 'image'))
SELECT (SELECT count(*) FROM k) AS n_captions, (SELECT count(DISTINCT doc_id) FROM k) AS n_captioned, (SELECT n FROM x) AS n_leakage_violations, (SELECT count(*) FROM c WHERE support <> '') AS n_claims, (SELECT count(*) FROM c WHERE contains(support, '+')) AS n_relations, (SELECT count(*) FROM c WHERE support <> '' AND NOT contains(support, '+')) AS n_observations,
(SELECT count(*) FROM {{prose}}) AS n_objects, (SELECT count(*) FROM {{prose}}) - (SELECT count(DISTINCT doc_id) FROM k) AS n_without_text, (SELECT count(*) FROM c) AS n_sentences, round((SELECT count(*) FROM c WHERE support <> '') / (SELECT count(*) FROM c), 6) AS survival_rate""")
def d4(prose: DataFrame) -> DataFrame:
    sets = F.when(F.col("doc_id") % 4 != 0, F.array(F.lit("image"), F.lit("lightcurve"), F.lit("spectra"))).otherwise(F.array(F.lit("image"), F.lit("lightcurve")))
    claims = _claims(prose)
    made = captions.compose_captions(claims, prose.select("doc_id", sets.alias("subset")), "doc_id")
    # A third of the captions lose a modality after they were made, so their claims of it leak.
    made = made.withColumn("subset", F.when(F.col("doc_id") % 3 == 0, F.array_remove("subset", "image")).otherwise(F.col("subset")))
    sentences = prose.select("doc_id", F.explode(t.split_sentences(F.col("text"))))
    return captions.caption_report(made, claims, sentences, prose, "doc_id")


@query("d4_match_rates", "objects", "labels", sql="""
WITH h AS (SELECT object_id, 'label' AS modality FROM {objects} WHERE has_label UNION SELECT object_id, 'vector' FROM {objects} WHERE has_vector),
c AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS object_id, CASE WHEN quality = 1 THEN 'label' ELSE 'vector' END AS modality FROM {labels})
SELECT coalesce(h.modality, c.modality) AS modality, count(h.object_id) AS n_available, count(*) FILTER (WHERE h.object_id IS NOT NULL AND c.object_id IS NOT NULL) AS n_matched,
count(*) FILTER (WHERE c.object_id IS NULL) AS n_unmatched, round(count(*) FILTER (WHERE h.object_id IS NOT NULL AND c.object_id IS NOT NULL) / nullif(count(h.object_id), 0), 6) AS match_rate, count(*) FILTER (WHERE h.object_id IS NULL) AS n_foreign
FROM h FULL OUTER JOIN c ON h.object_id = c.object_id AND h.modality = c.modality GROUP BY 1""")
def d4_rates(objects: DataFrame, labels: DataFrame) -> DataFrame:
    have = objects.where("has_label").select("object_id", F.lit("label").alias("modality")).unionByName(objects.where("has_vector").select("object_id", F.lit("vector").alias("modality")))
    captioned = labels.select(F.col("doc_id").cast("string").alias("object_id"), F.when(F.col("quality") == 1, "label").otherwise("vector").alias("modality"))
    return captions.match_rates(have, captioned)


@query("d5_joint_claims", "prose", sql=f"WITH {CLAIMS} SELECT round(avg(CAST(contains(support, '+') AS INT)), 6) AS joint_fraction FROM c WHERE support <> ''")
def d5(prose: DataFrame) -> DataFrame:
    return captions.joint_claim_fraction(_claims(prose))


@query("d6_diversity_gate", "documents", sql="""
WITH t AS (SELECT text, count(*) AS n FROM {documents} GROUP BY text), a AS (SELECT sum(n) AS n, count(*) AS d, max(n) AS m FROM t)
SELECT CAST(n AS BIGINT) AS n_captions, d AS n_distinct, round(d / n, 6) AS distinct_share, round(m / n, 6) AS top_share, sha256((SELECT substr(text, 1, 200) FROM t ORDER BY t.n DESC, text DESC LIMIT 1)) AS top_digest, d / n >= 0.8 AND m / n <= greatest(0.05, 1.5 / n) AS passed FROM a""")
def d6(documents: DataFrame) -> DataFrame:
    return captions.diversity_gate(documents).select("n_captions", "n_distinct", "distinct_share", "top_share", F.sha2("top_text", 256).alias("top_digest"), "passed")


@query("d7_change_gate", "orders", sql="""
SELECT round(avg(levenshtein(o_orderpriority, '3-MEDIUM')), 6) AS mean_distance, round(avg(CAST(o_orderpriority <> '3-MEDIUM' AS INT)), 6) AS changed_share, avg(levenshtein(o_orderpriority, '3-MEDIUM')) < 3 AS null_distance, avg(CAST(o_orderpriority <> '3-MEDIUM' AS INT)) < 0.1 AS null_changed FROM {orders}""")
def d7(orders: DataFrame) -> DataFrame:
    return captions.change_gate(orders.select(F.col("o_orderpriority").alias("a"), F.lit("3-MEDIUM").alias("b")), "a", "b")


@query("d23_mentions_summary", "quotes", sql="SELECT conv_id, count(DISTINCT role) AS n_mentions, count(*) AS n_quotes FROM {quotes} GROUP BY 1")
def d23(rows: DataFrame) -> DataFrame:
    return captions.mentions_summary(rows.withColumn("q", F.array("text")), "conv_id", "role", "q")


@query("d24_lines_by_snr", "multi", sql="SELECT sample_id, string_agg(concat(label, k, printf(' (SNR: %.1f)', snr)), '|' ORDER BY snr DESC, concat(label, k)) AS lines FROM {multi} GROUP BY 1")
def d24(multi: DataFrame) -> DataFrame:
    named = multi.withColumn("name", F.concat("label", F.col("k").cast("string")))
    return scoring.lines_by_snr(named, "sample_id", "name", "snr").select("sample_id", F.array_join("lines", "|").alias("lines"))


@query("d25_redshift_labels", "catalog_a", sql="""
WITH m AS (SELECT survey, avg(dist) AS z FROM {catalog_a} GROUP BY 1) SELECT survey, round(z, 6) AS mean_z, chr(CAST(64 + row_number() OVER (ORDER BY z, survey) AS INT)) AS letter FROM m""")
def d25(catalog: DataFrame) -> DataFrame:
    return scoring.redshift_labels(catalog, "survey", "dist")


@query("d30_class_weights", "predictions", sql="SELECT truth, count(*) AS n, round(sum(count(*)) OVER () / (5 * count(*)), 6) AS weight FROM {predictions} GROUP BY truth")
def d30(rows: DataFrame) -> DataFrame:
    return captions.class_weights(rows, "truth", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).withColumn("weight", F.round("weight", 6))


# --- answers ------------------------------------------------------------------------------------------------------------

INPUTS["answers"] = """
SELECT o_orderkey AS k, o_orderpriority AS label, concat(CASE WHEN o_orderkey % 4 = 0 THEN 'It looks LOW but ' WHEN o_orderkey % 4 = 1 THEN 'Class 12, then 3. ' ELSE 'Maybe high. ' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'no idea' WHEN o_orderkey % 5 = 1 THEN 'final answer: B' WHEN o_orderkey % 5 = 2 THEN concat('FINAL ANSWER: A, C and ', substring(o_orderpriority, 3, 1)) WHEN o_orderkey % 5 = 3 THEN 'FINAL ANSWER: none' ELSE concat('it is ', lower(substring(o_orderpriority, 3, 20)), '.') END) AS text FROM {orders}"""
#: Answers in more forms: bold and bracketed letters, two final lines, words behind the letter, a blank before the colon.
INPUTS["replies"] = """
SELECT k, label, text AS said, CASE k % 9 WHEN 0 THEN concat(text, chr(10), 'FINAL ANSWER: **B**') WHEN 1 THEN 'FINAL ANSWER: A, because' WHEN 2 THEN concat('FINAL ANSWER: Low', chr(10), 'Final answer: High')
  WHEN 3 THEN 'final answer : medium, not high' WHEN 4 THEN concat('FINAL ANSWER: option(C).', chr(10), 'FINAL ANSWER: Z') WHEN 5 THEN 'FINAL ANSWER: [a]' WHEN 6 THEN concat('FINAL ANSWER:', chr(10), 'B') WHEN 7 THEN 'Choice urgent. FINAL ANSWER: choice C: ' ELSE text END AS text FROM {answers}"""
WORDS = {"Urgent": ["quick"], "High": ["tall"], "Medium": ["middle"], "Low": ["small"]}


def _contains(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query("g6_predict_label", "answers", sql=f"SELECT k, CASE WHEN {_contains(['urgent', 'quick'])} THEN 'Urgent' WHEN {_contains(['high', 'tall'])} THEN 'High' WHEN {_contains(['medium', 'middle'])} THEN 'Medium' WHEN {_contains(['low', 'small'])} THEN 'Low' END AS label FROM {{answers}}")
def g6(answers: DataFrame) -> DataFrame:
    return answers.select("k", t.predict_label(F.col("text"), WORDS).alias("label"))


@query("g7_predict_code", "answers", sql="SELECT k, CASE WHEN k % 4 = 1 THEN 'three' END AS label FROM {answers}")
def g7(answers: DataFrame) -> DataFrame:
    return answers.select("k", t.predict_code(F.col("text"), {"3": "three", "1": "one"}).alias("label"))


def _last(word: str) -> str:
    return f"coalesce(length(nullif(regexp_extract(lower(text), '(?s)^.*\\b{word}\\b', 0), '')), 0)"


@query("g8_last_mention", "answers", sql=f"""
WITH e AS (SELECT k, unnest([{{'e': {_last('urgent')}, 'o': 0, 'l': 'Urgent'}}, {{'e': {_last('high')}, 'o': 1, 'l': 'High'}}, {{'e': {_last('medium')}, 'o': 2, 'l': 'Medium'}}, {{'e': {_last('low')}, 'o': 3, 'l': 'Low'}}], recursive := true) FROM {{answers}})
SELECT k, CASE WHEN max(e) > 0 THEN arg_max(l, e * 10 - o) END AS label FROM e GROUP BY k""")
def g8(answers: DataFrame) -> DataFrame:
    return answers.select("k", t.last_mention(F.col("text"), {w: [] for w in WORDS}).alias("label"))


#: What is said last, in the final line if it names a label, else in the whole reply; the rule of ``verbose_class``.
SAID_LAST = f"""two AS (SELECT k, 0 AS whole, regexp_extract(text, '(?i)FINAL ANSWER\\s*:\\s*([^\\n]+)', 1) AS text FROM {{replies}} UNION ALL SELECT k, 1, text FROM {{replies}}),
e AS (SELECT k, whole, unnest([{{'e': {_last('urgent')}, 'o': 0, 'l': 'Urgent'}}, {{'e': {_last('high')}, 'o': 1, 'l': 'High'}}, {{'e': {_last('medium')}, 'o': 2, 'l': 'Medium'}}, {{'e': {_last('low')}, 'o': 3, 'l': 'Low'}}], recursive := true) FROM two),
b AS (SELECT k, whole, CASE WHEN max(e) > 0 THEN arg_max(l, e * 10 - o) END AS label FROM e GROUP BY ALL),
last AS (SELECT k, coalesce(max(CASE WHEN whole = 0 THEN label END), max(CASE WHEN whole = 1 THEN label END)) AS label FROM b GROUP BY k)"""
SAID_FIRST = f"CASE WHEN {_contains(['urgent', 'quick'])} THEN 'Urgent' WHEN {_contains(['high', 'tall'])} THEN 'High' WHEN {_contains(['medium', 'middle'])} THEN 'Medium' WHEN {_contains(['low', 'small'])} THEN 'Low' END"


@query("g8_free_text", "replies", sql=f"WITH {SAID_LAST} SELECT k, label FROM last")
def g8_free(replies: DataFrame) -> DataFrame:
    return replies.select("k", t.predict_free_text(F.col("text"), {w: [] for w in WORDS}).alias("label"))


@query("g9_predictor_formats", "replies", sql=f"""
WITH {SAID_LAST} SELECT 'verbose_class' AS format, k, label FROM last
UNION ALL SELECT unnest(['free_text', 'of a later version']), k, {SAID_FIRST} FROM {{replies}}
UNION ALL SELECT 'logprob_argmax', k, label FROM {{replies}} UNION ALL SELECT 'digit_code', k, CASE WHEN text LIKE '%Class 12, then 3.%' THEN 'three' END FROM {{replies}}""")
def g9(replies: DataFrame) -> DataFrame:
    out = None
    for name in ("verbose_class", "free_text", "of a later version", "logprob_argmax", "digit_code"):
        words = {w: [] for w in WORDS} if name == "verbose_class" else WORDS
        predict = t.make_predictor(name, words, {"3": "three", "1": "one"})
        one = replies.select(F.lit(name).alias("format"), "k", predict(F.col("text"), F.col("label")).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


@query("g10_argmax_label", "embeddings", sql="SELECT vec_id, CAST(list_position(list_slice(embedding, 1, 5), list_max(list_slice(embedding, 1, 5))) AS VARCHAR) AS label FROM {embeddings}")
def g10(embeddings: DataFrame) -> DataFrame:
    keys = F.array(*[F.lit(f" {k} ") for k in range(1, 6)])
    return embeddings.select("vec_id", t.argmax_label(F.map_from_arrays(keys, F.slice("embedding", 1, 5))).alias("label"))


@query("d14_margin_block", "embeddings", sql="""
WITH s AS (SELECT list_sort(list_transform(embedding, lambda x : CAST(x AS DOUBLE)), 'DESC') AS v FROM {embeddings})
SELECT count(*) AS n, round(avg(v[1] - v[2]), 5) AS mean_margin, count(*) FILTER (WHERE v[1] - v[2] < 0.02) AS n_narrow FROM s""")
def d14(embeddings: DataFrame) -> DataFrame:
    out = scoring.margin_block(embeddings, t.margin(F.transform("embedding", lambda x: x.cast("double"))), 0.02)
    return out.withColumn("mean_margin", F.round("mean_margin", 5))


@query("g11_final_sentence", "answers", sql="""
WITH l AS (SELECT k, lower(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1¦', 'g'), '¦'), lambda s : s <> '')[-1]) AS s FROM {answers}),
n AS (SELECT k, len(regexp_extract_all(s, '\\bhigh\\b')) AS h, len(regexp_extract_all(s, '\\blow\\b')) AS w, len(regexp_extract_all(s, '\\bmedium\\b')) AS m FROM l)
SELECT k, CASE WHEN h + w + m = 1 THEN CASE WHEN h = 1 THEN 'High' WHEN w = 1 THEN 'Low' ELSE 'Medium' END END AS label FROM n""")
def g11(answers: DataFrame) -> DataFrame:
    return answers.select("k", t.parse_final_sentence(F.col("text"), ["High", "Low", "Medium"]).alias("label"))


#: The last letter among A, B and C that stands alone behind FINAL ANSWER:
CHOICE = f"""list_filter(list_transform(regexp_extract_all(text, '{t.CHOICE}', 1), lambda x : upper(x)), lambda x : x IN ('A', 'B', 'C'))[-1]"""


@query("g12_single_choice", "replies", sql=f"SELECT k, {CHOICE} AS letter FROM {{replies}}")
def g12(replies: DataFrame) -> DataFrame:
    return replies.select("k", t.parse_single_choice(F.col("text"), "ABC").alias("letter"))


#: Lists of letters: letters in words and beside digits or underscores, small ones, repeats, NONE with and without others.
INPUTS["lists"] = """
SELECT k, CASE k % 10 WHEN 0 THEN 'FINAL ANSWER: A1, B' WHEN 1 THEN 'FINAL ANSWER: a, (b), A' WHEN 2 THEN 'FINAL ANSWER: NONE' WHEN 3 THEN 'final answer: None of these, but C' WHEN 4 THEN 'FINAL ANSWER: Z and 3'
  WHEN 5 THEN concat('FINAL ANSWER: A', chr(10), 'FINAL ANSWER: B_, H-C ', label) WHEN 6 THEN concat('FINAL ANSWER:', chr(10), 'C; b') WHEN 7 THEN 'the answer is A' WHEN 8 THEN 'FINAL ANSWER: é A éB' ELSE text END AS text FROM {answers}"""


@query("g13_multi_choice", "lists", sql="""
WITH l AS (SELECT k, regexp_extract_all(text, '(?i)FINAL ANSWER:\\s*([^\\n]*)', 1)[-1] AS line FROM {lists}),
w AS (SELECT k, line, list_filter(list_transform(regexp_split_to_array(line, '[^\\pL\\pN_]+'), lambda x : upper(x)), lambda x : x IN ('A', 'B', 'C', 'H')) AS found FROM l)
SELECT k, CASE WHEN line IS NOT NULL THEN coalesce(array_to_string(list_transform(list_filter(list_zip(found, range(1, len(found) + 1)), lambda z : list_position(found, z[1]) = z[2]), lambda z : z[1]), ','), '') END AS letters FROM w""")
def g13(lists: DataFrame) -> DataFrame:
    return lists.select("k", F.array_join(t.parse_multi_choice(F.col("text"), "ABCH"), ",").alias("letters"))


def _named(word: str) -> str:
    return f"regexp_matches(text, '(?i)\\b{word}\\b')"


#: Replies that name two categories, class keys, parts of words, or nothing.
INPUTS["task_replies"] = """
SELECT k, CASE k % 11 WHEN 0 THEN 'Low rather than high' WHEN 1 THEN 'surely a rush order' WHEN 2 THEN 'highly likely lower' WHEN 3 THEN 'it can wait, a medium one' WHEN 4 THEN 'IT CAN WAIT' ELSE text END AS text FROM {replies}"""


@query("g14_task_answer", "task_replies", sql=f"""
SELECT k, coalesce(CASE {CHOICE} WHEN 'A' THEN 'High' WHEN 'B' THEN 'Medium' WHEN 'C' THEN 'Low' END, CASE WHEN {_named('high')} THEN 'High' WHEN {_named('medium')} THEN 'Medium' WHEN {_named('low')} THEN 'Low' WHEN {_named('can wait')} THEN 'Low' WHEN {_named('rush')} THEN 'High' END) AS label FROM {{task_replies}}""")
def g14(replies: DataFrame) -> DataFrame:
    return replies.select("k", t.parse_task_answer(F.col("text"), {"A": "High", "B": "Medium", "C": "Low"}, {"can wait": "Low", "rush": "High"}).alias("label"))


@query("g15_ground_truth", "orders", sql="SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low' WHEN '3-MEDIUM' THEN 'Middle' ELSE 'UNKNOWN' END AS class FROM {orders}")
def g15(orders: DataFrame) -> DataFrame:
    truth = t.ground_truth_class(F.col("o_orderpriority"), {"1-URGENT": "Urgent", "5-low": "Low"}, {"3-medium": "Middle"})
    return orders.select("o_orderkey", truth.alias("class"))


@query("g15_ground_truth_lines", "multi", sql="""
WITH d AS (SELECT sample_id, label, max(CASE WHEN k % 2 = 1 THEN snr END) AS snr FROM {multi} GROUP BY ALL)
SELECT sample_id, string_agg(label || '=' || printf('%.1f', coalesce(snr, 1.0)), ';' ORDER BY label) AS truth, count(*) AS n FROM d GROUP BY 1""")
def g15_lines(multi: DataFrame) -> DataFrame:
    known = F.map_from_entries(F.collect_list(F.when(F.col("snr").isNotNull(), F.struct("label", "snr"))))
    per = multi.groupBy("sample_id", "label").agg(F.max(F.when(F.col("k") % 2 == 1, F.col("snr"))).alias("snr"))
    lists = per.groupBy("sample_id").agg(F.collect_list("label").alias("detected"), known.alias("snr_of"))
    truth = F.map_concat(t.ground_truth_lines(F.col("detected"), F.col("snr_of")), F.create_map(F.lit("regime"), F.lit(0.0)))
    named = lists.select("sample_id", truth.alias("truth")).withColumn("names", t.truth_labels(F.col("truth")))
    shown = F.transform("names", lambda x: F.concat(x, F.lit("="), F.format_string("%.1f", F.try_element_at("truth", x))))
    return named.select("sample_id", F.array_join(shown, ";").alias("truth"), F.size("names").cast("long").alias("n"))


@query("g16_extract_caption", "answers", sql="SELECT k, k % 2 = 0 AS has, CASE WHEN k % 2 = 0 THEN label ELSE trim(text) END AS caption FROM {answers}")
def g16(answers: DataFrame) -> DataFrame:
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.lit("x CAPTION: a\nCaption: \""), "label", F.lit("\"  "))).otherwise(F.col("text"))
    return answers.select("k", t.has_caption(raw).alias("has"), t.extract_caption(raw).alias("caption"))


@query("g20_build_prompt", "orders", sql="SELECT o_orderkey, concat('Class ', o_orderstatus, chr(10), 'A) ', o_orderpriority, chr(10), 'B) none', chr(10), '1. ', CAST(o_custkey AS VARCHAR)) AS prompt FROM {orders}")
def g20(orders: DataFrame) -> DataFrame:
    options = t.lettered(F.array(F.col("o_orderpriority"), F.lit("none")))
    quotes = t.numbered(F.array(F.col("o_custkey").cast("string")))
    return orders.select("o_orderkey", t.fill_template("Class {cls}\n{options}\n{quotes}", cls=F.col("o_orderstatus"), options=options, quotes=quotes).alias("prompt"))


@query("g21_human_subset", "objects", sql="""
SELECT object_id, concat('The ', concat_ws(' and ', CASE WHEN has_label THEN 'a label' END, 'text'), ' of:', ' end') AS text FROM {objects}""")
def g21(objects: DataFrame) -> DataFrame:
    subset = F.array_compact(F.array(F.when(F.col("has_label"), "label"), F.lit("text")))
    return objects.select("object_id", t.wrapper_text(subset, {"label": "a label"}, "The {modalities} of:", " end").alias("text"))


@query("g22_fingerprint", "orders", sql="""
SELECT o_orderkey, sha256(concat('{"o_custkey":', o_custkey, ',"o_orderstatus":"', o_orderstatus, '"}')) AS fingerprint, substr(sha256(concat('{"o_custkey":', o_custkey, '}')), 1, 16) AS short FROM {orders}""")
def g22(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", c.fingerprint(F.col("o_custkey"), F.col("o_orderstatus")).alias("fingerprint"), c.short_fingerprint(F.col("o_custkey")).alias("short"))


@query("g23_edit_distance", "orders", sql="SELECT o_orderkey, CAST(levenshtein(o_orderpriority, concat(o_orderstatus, '-LOW')) AS INT) AS distance FROM {orders}")
def g23(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", t.edit_distance(F.col("o_orderpriority"), F.concat("o_orderstatus", F.lit("-LOW"))).alias("distance"))


@query("g27_snr_and_haversine", "odd_points", sql="SELECT pos, round(CASE WHEN err > 3 AND NOT isnan(err) THEN flux / (err - 3) ELSE 0 END, 6) AS snr, round(degrees(2 * asin(sqrt(pow(sin(radians(0.5) / 2), 2) + cos(radians(10)) * cos(radians(10.5)) * pow(sin(radians(pos % 90) / 2), 2)))) * 3600, 4) AS sep FROM {odd_points}")
def g27(points: DataFrame) -> DataFrame:
    sep = c.haversine_arcsec(F.lit(0.0), F.lit(10.0), (F.col("pos") % 90).cast("double"), F.lit(10.5))
    return points.select("pos", F.round(c.snr(F.col("flux"), F.col("err") - 3), 6).alias("snr"), F.round(sep, 4).alias("sep"))


@query("g28_is_correct", "predictions", sql="SELECT sample_id, coalesce(lower(trim(predicted)) = lower(trim(truth)), false) AS correct FROM {predictions}")
def g28(rows: DataFrame) -> DataFrame:
    return rows.select("sample_id", t.is_correct(F.concat(F.lit(" "), F.lower("predicted")), F.col("truth")).alias("correct"))


@query("g29_caption_target", "prose", sql="SELECT doc_id, sha256(concat_ws(' ', list_aggregate(list_slice(list_filter(string_split_regex(text, '\\s+'), lambda w : w <> ''), 1, 8), 'string_agg', ' '), 'the end')) AS digest FROM {prose} WHERE trim(text) <> ''")
def g29(prose: DataFrame) -> DataFrame:
    return prose.where("trim(text) <> ''").select("doc_id", F.sha2(t.caption_target(F.col("text"), "the end", 10), 256).alias("digest"))


@query("g30_build_record", "orders", sql="""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, 1.5) AS ra, lower(o_orderstatus) AS survey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS caption, o_orderkey % 3 = 0 OR o_orderpriority = '5-LOW' AS is_insufficient FROM {orders}""")
def g30(orders: DataFrame) -> DataFrame:
    df = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("ra"), F.lit(0.0).alias("dec"), F.lit(1.5).alias("ra_fallback"), F.lit(0.0).alias("dec_fallback"), F.col("o_orderstatus").alias("survey"), F.lit(1).alias("n_quotes"), F.lit(1).alias("n_mentions"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("caption"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"))
    out = captions.build_record(df, "5-LOW", "o_orderkey")
    return out.select("o_orderkey", "object.ra", "object.survey", "output.caption", "output.is_insufficient")
