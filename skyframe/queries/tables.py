"""Queries of sources, cleansing, validators, manifest and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions import columns as c
from skyframe.operators import captions, checks, clean, joins, splits
from skyframe.queries.base import INPUTS, query
from skyframe.sources import io

ID = r"CASE WHEN regexp_matches(trim(object_id), '^b''.*''$') THEN trim(regexp_extract(trim(object_id), '^b''(.*)''$', 1)) ELSE trim(object_id) END"


@query("a4_tag_survey", "catalog_a", sql="""
SELECT object_id, CASE WHEN seq % 2 = 0 THEN 'building' ELSE lower(trim(survey)) END AS survey FROM {catalog_a}""")
def a4(catalog: DataFrame) -> DataFrame:
    named = catalog.withColumn("_file", F.when(F.col("seq") % 2 == 0, "part-building-1.parquet").otherwise("part-1.parquet"))
    return io.tag_survey(named, ["building", "automobile", "machinery", "household", "furniture"]).select("object_id", "survey")


@query("a11_first_benchmark_wins", "customer", "orders", sql="""
WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_acctbal AS v, 0 AS src_rank FROM {customer}
UNION ALL SELECT CAST(o_custkey AS VARCHAR), max(o_totalprice), 1 FROM {orders} GROUP BY o_custkey)
SELECT sample_id, v, src_rank FROM u QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY src_rank) = 1""")
def a11(customer: DataFrame, orders: DataFrame) -> DataFrame:
    a = customer.select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_acctbal").alias("v"), F.lit("x").alias("only_a"))
    b = orders.groupBy(F.col("o_custkey").cast("string").alias("sample_id")).agg(F.max("o_totalprice").alias("v"))
    return io.load_all_unique([a, b])


@query("b1_canonical_id", "spellings", sql=f"SELECT src_rank, {ID} AS object_id FROM {{spellings}}")
def b1(rows: DataFrame) -> DataFrame:
    return rows.select("src_rank", c.canonical_id(F.col("object_id")).alias("object_id"))


@query("b2_id_report", "spellings", sql=f"""
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN object_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, CAST(sum(CASE WHEN {ID} <> object_id THEN 1 ELSE 0 END) AS BIGINT) AS n_rewritten,
count(DISTINCT object_id) AS n_spellings, count(DISTINCT {ID}) AS n_objects FROM {{spellings}}""")
def b2(rows: DataFrame) -> DataFrame:
    return clean.id_report(rows)


@query("b2_canonicalize_ids", "spellings", sql=f"SELECT src_rank, {ID} AS object_id, price FROM {{spellings}}")
def b2_ids(rows: DataFrame) -> DataFrame:
    return clean.canonicalize_ids(rows).select("src_rank", "object_id", "price")


@query("b3_propagate_first", "spellings", sql=f"""
WITH r AS (SELECT src_rank, {ID} AS object_id, split_label FROM {{spellings}}), f AS (SELECT object_id, arg_min(split_label, src_rank) AS first_label FROM r WHERE split_label IS NOT NULL GROUP BY object_id)
SELECT src_rank, r.object_id, coalesce(split_label, first_label) AS split_label FROM r LEFT JOIN f USING (object_id)""")
def b3(rows: DataFrame) -> DataFrame:
    out = clean.propagate_first(clean.canonicalize_ids(rows), "object_id", "split_label", "src_rank")
    return out.select("src_rank", "object_id", "split_label")


@query("b4_standardize", "supplier", sql="SELECT s_suppkey AS object_id, s_acctbal AS score, true AS has_image FROM {supplier}")
def b4(supplier: DataFrame) -> DataFrame:
    return clean.standardize(supplier.select("s_suppkey", "s_acctbal"), {"s_suppkey": "object_id", "s_acctbal": "score"}, ["image"])


@query("b5_availability_flags", "objects", sql="SELECT object_id, has_text, coalesce(has_label, false) AS has_label, coalesce(has_vector, false) AS has_vector, false AS has_image FROM {objects}")
def b5(objects: DataFrame) -> DataFrame:
    return clean.availability_flags(objects, ("image",)).select("object_id", "has_text", "has_label", "has_vector", "has_image")


TIER = "CASE WHEN CAST(has_text AS INT) + CAST(coalesce(has_label, false) AS INT) + CAST(coalesce(has_vector, false) AS INT) >= 2 THEN 'joint' ELSE 'single' END"


@query("b6_tier", "objects", sql=f"SELECT object_id, {TIER} AS tier FROM {{objects}}")
def b6(objects: DataFrame) -> DataFrame:
    return clean.with_tier(clean.availability_flags(objects)).select("object_id", "tier")


@query("b7_exclude_modality", "objects", sql="""
SELECT object_id, coalesce(has_label, false) AND NOT CAST(object_id AS BIGINT) % 6 = 0 AS has_label,
CASE WHEN 1 + CAST(coalesce(has_label, false) AND NOT CAST(object_id AS BIGINT) % 6 = 0 AS INT) + CAST(coalesce(has_vector, false) AS INT) >= 2 THEN 'joint' ELSE 'single' END AS tier FROM {objects}""")
def b7(objects: DataFrame) -> DataFrame:
    bad = objects.where("CAST(object_id AS BIGINT) % 6 = 0").select("object_id")
    return clean.exclude_modality(clean.availability_flags(objects), bad, "label").select("object_id", "has_label", "tier")


@query("b8_light_columns", "objects", sql="SELECT object_id, has_text, has_label, has_vector, survey, source FROM {objects}")
def b8(objects: DataFrame) -> DataFrame:
    return clean.light_columns(objects, ("quality", "split_upstream"))


@query("b9_clean_captions", "clean_ids", sql="""
SELECT nation AS object_id, arg_min(trim(raw), k) AS caption FROM {clean_ids} WHERE trim(raw) <> '' GROUP BY nation""")
def b9(rows: DataFrame) -> DataFrame:
    return clean.clean_captions(rows, "raw", "nation", "k").withColumnRenamed("nation", "object_id")


@query("b10_clean_quotes", "clean_ids", sql="""
SELECT nation, CAST(count(DISTINCT trim(raw)) AS INT) AS n_quotes, string_agg(DISTINCT trim(raw), '|' ORDER BY trim(raw)) AS quotes FROM {clean_ids} WHERE length(trim(raw)) >= 12 GROUP BY nation""")
def b10(rows: DataFrame) -> DataFrame:
    q = rows.groupBy("nation").agg(c.clean_quotes(F.collect_list("raw"), 12).alias("q")).where("size(q) > 0")
    return q.select("nation", F.size("q").alias("n_quotes"), F.array_join(F.array_sort("q"), "|").alias("quotes"))


@query("b11_extract_quotes", "quotes", sql="""
WITH f AS (SELECT object_id, trim(text, chr(32) || chr(10) || chr(9)) AS quote, min(pos) AS p FROM {quotes} GROUP BY ALL)
SELECT object_id, count(*) AS n_quotes, sha256(string_agg(quote, '|' ORDER BY p, quote)) AS digest FROM f WHERE length(quote) >= 20 GROUP BY object_id""")
def b11(rows: DataFrame) -> DataFrame:
    out = clean.extract_quotes(rows, "object_id", "pos", F.array(F.struct(F.col("text").alias("quote"))))
    return out.select("object_id", F.size("quotes").cast("long").alias("n_quotes"), F.sha2(F.array_join("quotes", "|"), 256).alias("digest"))


@query("b12_prepare_groups", "spellings", sql=f"""
WITH r AS (SELECT src_rank, {ID} AS object_id, lower(trim(status)) AS survey FROM {{spellings}})
SELECT src_rank, object_id, survey FROM r QUALIFY dense_rank() OVER (ORDER BY object_id) <= 50""")
def b12(rows: DataFrame) -> DataFrame:
    return clean.prepare_groups(rows, "object_id", ["o", "f", "p"], 50, survey="status").select("src_rank", "object_id", F.col("status").alias("survey"))


@query("b13_group_digest", "orders", sql="""
WITH r AS (SELECT o_custkey, sha256(concat('{"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '","price":', CASE WHEN o_orderkey % 7 < 2 THEN 'null' ELSE CAST(CAST(floor(o_totalprice) AS DOUBLE) AS VARCHAR) END, '}')) AS d FROM {orders})
SELECT o_custkey, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM r GROUP BY 1""")
def b13(orders: DataFrame) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).when(F.col("o_orderkey") % 7 == 1, float("inf")).otherwise(F.floor("o_totalprice").cast("double"))
    return clean.group_digest(orders.withColumn("price", price), "o_custkey", ["o_orderkey", "price", "o_orderstatus"])


@query("b14_distance_regime", "catalog_a", sql="""
SELECT object_id, CASE WHEN dist * 3 < 0.1 THEN 'very close (local universe)' WHEN dist * 3 < 0.5 THEN 'close' WHEN dist * 3 < 1 THEN 'intermediate' WHEN dist * 3 < 2 THEN 'far' ELSE 'very far (high redshift)' END AS regime FROM {catalog_a}""")
def b14(catalog: DataFrame) -> DataFrame:
    return catalog.select("object_id", c.distance_regime(F.col("dist") * 3).alias("regime"))


@query("b15_flux_to_magnitude", "points", sql="""
SELECT pos, round(CASE WHEN flux <> 0 THEN 27.5 - 2.5 * log10(abs(flux)) END, 6) AS mag, round(CASE WHEN flux <> 0 THEN err * 2.5 / ln(10) / abs(flux) END, 6) AS mag_err FROM {points}""")
def b15(points: DataFrame) -> DataFrame:
    return points.select("pos", F.round(c.magnitude(F.col("flux")), 6).alias("mag"), F.round(c.magnitude_error(F.col("flux"), F.col("err")), 6).alias("mag_err"))


@query("b16_band_names", "points", "orders", sql="""
SELECT 'points' AS what, CASE WHEN band_id = 1 THEN 'g' ELSE 'r' END AS band, count(*) AS n FROM {points} GROUP BY ALL
UNION ALL SELECT 'orders', lower(string_split_regex(trim(o_orderpriority), '[-_]')[-1]), count(*) FROM {orders} GROUP BY ALL""")
def b16(points: DataFrame, orders: DataFrame) -> DataFrame:
    a = points.groupBy(F.lit("points").alias("what"), c.band_name(F.col("band_id")).alias("band")).agg(F.count("*").alias("n"))
    return a.unionByName(orders.groupBy(F.lit("orders").alias("what"), c.canonical_band(F.col("o_orderpriority")).alias("band")).agg(F.count("*").alias("n")))


#: Every known line, an unknown one, and each of them as a broad line.
LINES = [*c.LINE_LABELS, "OTHER"]


@query("b17_line_labels", "lineitem", sql=f"""
SELECT l_orderkey, l_linenumber, concat(list_element([{', '.join(f"'{c.LINE_LABELS.get(v, v)}'" for v in LINES)}], CAST((l_orderkey + l_linenumber) % {len(LINES)} AS INT) + 1), CASE WHEN l_partkey % 2 = 0 THEN ' (broad)' ELSE '' END) AS label FROM {{lineitem}}""")
def b17(lineitem: DataFrame) -> DataFrame:
    name = F.get(F.array(*[F.lit(v) for v in LINES]), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(LINES)).cast("int"))
    return lineitem.select("l_orderkey", "l_linenumber", c.line_name(F.concat(name, F.when(F.col("l_partkey") % 2 == 0, "_BROAD").otherwise(""))).alias("label"))


@query("v1_not_unique", "spellings", sql=f"SELECT object_id, count(*) AS n_rows FROM (SELECT {ID} AS object_id FROM {{spellings}}) GROUP BY object_id HAVING count(*) > 1")
def v1(rows: DataFrame) -> DataFrame:
    return checks.not_unique(clean.canonicalize_ids(rows), "object_id")


@query("v2_overlap", "customer", "orders", sql="SELECT DISTINCT c_custkey AS k FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders})")
def v2(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return checks.overlap(customer.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k")), "k")


def _arrays(points: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", "mjd", "flux", "err", "band_id", "used")))
    return points.groupBy("object_id").agg(rows.alias("r")).select("object_id", *[F.col(f"r.{f}").alias(f) for f in ("mjd", "flux", "err", "band_id", "used")])


@query("v3_accepted_counts", "points", sql="""
SELECT object_id, CAST(sum(CAST(used AS INT)) AS INT) AS n_accepted, CAST(count(*) - 10 AS INT) AS n_stored FROM {points} GROUP BY object_id HAVING sum(CAST(used AS INT)) <> count(*) - 10""")
def v3(points: DataFrame) -> DataFrame:
    return checks.wrong_accepted_counts(_arrays(points).withColumn("n", F.size("mjd") - 10), "used", "n")


@query("v4_misaligned", "points", sql="SELECT object_id, true AS uneven, false AS no_point FROM {points} GROUP BY object_id HAVING CAST(object_id AS BIGINT) % 7 = 0")
def v4(points: DataFrame) -> DataFrame:
    odd = F.when(F.col("object_id").cast("long") % 7 == 0, F.slice("flux", 1, 3)).otherwise(F.col("flux"))
    return checks.misaligned(_arrays(points).withColumn("flux", odd), ["mjd", "flux", "err"], "used")


@query("v5_bad_texts", "clean_ids", sql="""
WITH m AS (SELECT nation, raw, count(*) OVER (PARTITION BY nation) AS n FROM {clean_ids})
SELECT nation, 'blank' AS problem FROM m WHERE trim(coalesce(raw, '')) = '' UNION ALL SELECT nation, 'too_long' FROM m WHERE length(raw) > 19 UNION ALL SELECT nation, 'duplicate' FROM m WHERE n > 1""")
def v5(rows: DataFrame) -> DataFrame:
    return checks.bad_texts(rows, "nation", "raw", 19)


@query("v6_class_counts", "orders", sql="""
SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'O' THEN 10 WHEN 'F' THEN 20 ELSE 0 END AS expected, count(*) AS found FROM {orders} GROUP BY o_orderstatus UNION ALL SELECT 'X', 5, 0""")
def v6(orders: DataFrame) -> DataFrame:
    return checks.wrong_class_counts(orders.withColumnRenamed("o_orderstatus", "status"), "status", {"O": 10, "F": 20, "X": 5}).select("status", F.col("expected").cast("int").alias("expected"), "found")


@query("v7_unknown_labels", "predictions", sql="SELECT sample_id, predicted FROM {predictions} WHERE predicted IS NULL OR predicted NOT IN ('1-URGENT', '3-MEDIUM')")
def v7(rows: DataFrame) -> DataFrame:
    return checks.unknown_labels(rows, "predicted", ["1-URGENT", "3-MEDIUM"]).select("sample_id", "predicted")


@query("v8_incomplete", "customer", "orders", sql="""
SELECT c_custkey AS k, 'missing' AS problem FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})
UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_custkey % 10 <> 0 OR c_custkey NOT IN (SELECT o_custkey FROM {orders}))
""")
def v8(customer: DataFrame, orders: DataFrame) -> DataFrame:
    done = orders.select(F.col("o_custkey").alias("k")).distinct()
    some = customer.select(F.col("c_custkey").alias("k"))
    return checks.incomplete(some.join(done.where("k % 10 = 0"), "k", "left_anti"), done, "k")


@query("v9_stale_records", "ledger", sql="""
SELECT object_id, concat_ws(',', CASE WHEN status <> 'assistant' THEN 'status' END, CASE WHEN tokens <> 5 THEN 'tokens' END) AS stale FROM {ledger} WHERE status <> 'assistant' OR tokens <> 5""")
def v9(ledger: DataFrame) -> DataFrame:
    want = ledger.select("object_id").distinct().select("object_id", F.lit("assistant").alias("status"), F.lit(5).cast("long").alias("tokens"))
    return checks.stale_records(ledger.withColumn("tokens", F.col("tokens").cast("long")), want, "object_id", ["status", "tokens"], F.lit(False))


@query("v10_two_splits", "orders", sql="SELECT o_custkey AS object_id, count(DISTINCT o_orderstatus) AS n_splits FROM {orders} GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def v10(orders: DataFrame) -> DataFrame:
    return checks.in_two_splits(orders.select(F.col("o_custkey").alias("object_id"), F.col("o_orderstatus").alias("split")), "object_id")


def _waves(arr: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", "wave", "flux", "ivar", "masked")))
    return arr.groupBy("object_id").agg(rows.alias("r")).select("object_id", *[F.col(f"r.{f}").alias(f) for f in ("wave", "flux", "ivar", "masked")])


@query("v11_increasing_grid", "arr", sql="""
WITH s AS (SELECT object_id, row_number() OVER w AS i, wave, lead(wave) OVER w AS nxt FROM {arr} WINDOW w AS (PARTITION BY object_id ORDER BY pos, wave, flux))
SELECT object_id, min(i) AS first_bad FROM s WHERE nxt <= wave GROUP BY object_id""")
def v11(arr: DataFrame) -> DataFrame:
    return checks.not_increasing(_waves(arr), "wave")


INPUTS["claims"] = "SELECT o_orderkey AS object_id, o_orderkey % 3 AS kind, o_orderpriority AS text, o_custkey % 4 AS sub FROM {orders}"


@query("v12_leaking_claims", "claims", sql="""
SELECT object_id, text, CASE kind WHEN 1 THEN 'image' ELSE 'image+spectra' END AS outside FROM {claims} WHERE kind > 0 AND sub = 0
UNION ALL SELECT object_id, text, 'spectra' FROM {claims} WHERE kind = 2 AND sub = 1""")
def v12(rows: DataFrame) -> DataFrame:
    lists = lambda *names: F.array(*[F.lit(n) for n in names])
    support = F.when(F.col("kind") == 0, lists("lightcurve")).when(F.col("kind") == 1, lists("image")).otherwise(lists("image", "spectra"))
    subset = F.when(F.col("sub") == 0, lists("lightcurve")).when(F.col("sub") == 1, lists("image", "lightcurve")).otherwise(lists("image", "spectra", "lightcurve"))
    return checks.leaking_claims(rows.select("object_id", subset.alias("subset"), F.array(F.struct("text", support.alias("supporting"))).alias("claims")), "object_id", "subset", "claims")


@query("v14_unfounded_quotes", "quotes", sql="SELECT object_id, pos, substr(text, 3, 12) || '#' AS quote FROM {quotes} WHERE pos % 2 = 1 AND NOT contains(text, substr(text, 3, 12) || '#')")
def v14(rows: DataFrame) -> DataFrame:
    part = F.substring("text", 3, 12)
    marked = rows.select(F.struct("object_id", "pos").alias("k"), "text", F.array(F.when(F.col("pos") % 2 == 1, F.concat(part, F.lit("#"))).otherwise(part)).alias("q"))
    return checks.unfounded_quotes(marked, "k", "text", "q").select("k.object_id", "k.pos", "quote")


@query("v15_table_rows", "points", sql="""
WITH s AS (SELECT object_id, pos, band_id, mjd, lag(mjd) OVER (PARTITION BY object_id ORDER BY pos) AS b FROM {points})
SELECT object_id, pos, band_id <> 1 AS bad_band, coalesce(mjd < b, false) AS out_of_order FROM s WHERE band_id <> 1 OR coalesce(mjd < b, false)""")
def v15(points: DataFrame) -> DataFrame:
    named = points.withColumn("band", F.when(F.col("band_id") == 1, "g").otherwise("z"))
    return checks.bad_table_rows(named, "object_id", "pos", "mjd", "band")


@query("v16_cache_specs", "orders", sql="SELECT DISTINCT o_orderstatus AS spec, 'a' AS version FROM {orders} WHERE o_orderstatus <> 'O'")
def v16(orders: DataFrame) -> DataFrame:
    return checks.stale_cache_specs(orders.select(F.col("o_orderstatus").alias("spec"), F.lit("a").alias("version")), {"spec": "O", "version": "a"})


@query("v17_non_finite", "embeddings", sql="SELECT vec_id AS object_id FROM {embeddings} WHERE vec_id % 5 = 0")
def v17(embeddings: DataFrame) -> DataFrame:
    bad = F.when(F.col("vec_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(0.0))
    tokens = F.array(F.transform("embedding", lambda x: x.cast("double") + bad))
    return checks.non_finite(embeddings.select(F.col("vec_id").alias("object_id"), tokens.alias("e")), "e")


@query("d1_histograms", "objects", sql=f"SELECT {TIER} AS tier, count(*) AS n FROM {{objects}} GROUP BY 1")
def d1(objects: DataFrame) -> DataFrame:
    return captions.tier_histogram(clean.with_tier(clean.availability_flags(objects)), "tier")


@query("d2_availability", "objects", sql="""
SELECT concat_ws('+', CASE WHEN has_label THEN 'label' END, 'text', CASE WHEN has_vector THEN 'vector' END) AS combination, count(*) AS n FROM {objects} GROUP BY 1
UNION ALL SELECT concat('only:', m), n FROM (SELECT 'text' AS m, count(*) FILTER (WHERE has_label IS NULL AND has_vector IS NULL) AS n FROM {objects} UNION ALL SELECT 'label', 0 UNION ALL SELECT 'vector', 0)""")
def d2(objects: DataFrame) -> DataFrame:
    flags = clean.availability_flags(objects)
    return captions.availability_histogram(flags).unionByName(captions.only_counts(flags).select(F.concat(F.lit("only:"), "modality").alias("combination"), "n"))


DRAW = "sha256(concat('42:', object_id))"
SPLIT = f"""WITH t AS (SELECT object_id, coalesce(survey, '(none)') AS s, {TIER} AS tier FROM {{objects}}),
r AS (SELECT *, row_number() OVER (PARTITION BY s, tier ORDER BY {DRAW}, object_id) AS i, count(*) OVER (PARTITION BY s, tier) AS n FROM t),
split AS (SELECT object_id, s, tier, CASE WHEN i <= round_even(n * 0.1, 0) THEN 'val' WHEN i <= round_even(n * 0.1, 0) + round_even(n * 0.15, 0) THEN 'test' ELSE 'train' END AS split FROM r)"""


def _with_splits(objects: DataFrame, **how) -> DataFrame:
    return splits.assign_splits(clean.with_tier(clean.availability_flags(objects)), val=0.1, test=0.15, strata=("survey", "tier"), **how)


@query("d3_split_balance", "objects", sql=f"""{SPLIT}
SELECT CASE WHEN s <> '(none)' THEN s END AS survey, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test,
round(count(*) FILTER (WHERE split = 'train') / count(*), 6) AS train_share, count(*) >= 50 AND count(*) FILTER (WHERE split = 'train') / count(*) < 0.5 AS unbalanced FROM split GROUP BY s""")
def d3(objects: DataFrame) -> DataFrame:
    return captions.split_balance(_with_splits(objects))


@query("e1_dedup_closest", "spellings", sql=f"""
SELECT object_id, src_rank, dist FROM (SELECT {ID} AS object_id, src_rank, dist FROM {{spellings}}) QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY dist ASC NULLS LAST, src_rank) = 1""")
def e1(rows: DataFrame) -> DataFrame:
    return clean.dedup_closest(clean.canonicalize_ids(rows), "object_id", "dist", "src_rank").select("object_id", "src_rank", "dist")


@query("e2_assign_splits", "objects", sql=f"{SPLIT} SELECT object_id, split FROM split")
def e2(objects: DataFrame) -> DataFrame:
    return _with_splits(objects).select("object_id", "split")


@query("e2_upstream_splits", "objects", sql=f"""
WITH t AS (SELECT object_id, split_upstream AS u, coalesce(survey, '(none)') AS s, {TIER} AS tier FROM {{objects}}),
p AS (SELECT *, CASE WHEN u = 'train' THEN 'upstream' WHEN u IS NULL AND tier = 'joint' THEN 'draw' END AS pool FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY pool, s, tier ORDER BY {DRAW}, object_id) AS i, count(*) OVER (PARTITION BY pool, s, tier) AS n FROM p)
SELECT object_id, CASE WHEN u = 'test' THEN 'test' WHEN pool IS NULL THEN 'train' WHEN i <= round_even(n * 0.1, 0) THEN 'val' WHEN pool = 'draw' AND i <= round_even(n * 0.1, 0) + round_even(n * 0.15, 0) THEN 'test' ELSE 'train' END AS split FROM r""")
def e2_upstream(objects: DataFrame) -> DataFrame:
    return _with_splits(objects, policy="auto", upstream="split_upstream").select("object_id", "split")


@query("e3_stratified_sample", "objects", sql="""
WITH v AS (SELECT * FROM (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) AS t(label, o)), c AS (SELECT label, o, count(survey) AS size FROM v LEFT JOIN {objects} ON survey = label GROUP BY ALL),
s AS (SELECT *, size * 60 / sum(size) OVER () AS share FROM c), f AS (SELECT *, least(size, greatest(3, floor(share))) AS fl, row_number() OVER (ORDER BY share - floor(share) DESC, o) AS rk FROM s),
q AS (SELECT label, CAST(fl + CASE WHEN rk <= 60 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)
SELECT object_id, survey FROM {objects} JOIN q ON label = survey QUALIFY row_number() OVER (PARTITION BY survey ORDER BY sha256(concat('42:', object_id)), object_id) <= quota""")
def e3(objects: DataFrame) -> DataFrame:
    return splits.stratified_sample(objects.where("survey IS NOT NULL"), "survey", 60, ["de", "en", "es", "fr"], 3).select("object_id", "survey")


@query("e4_balanced_sample", "objects", sql="""
SELECT object_id, survey FROM {objects} WHERE survey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY survey ORDER BY sha256(concat('42:', object_id)), object_id) <= 10""")
def e4(objects: DataFrame) -> DataFrame:
    return splits.balanced_sample(objects.where("survey IS NOT NULL"), "survey", 10).select("object_id", "survey")


@query("e5_cv_folds", "objects", sql="""
SELECT object_id, survey, CAST((row_number() OVER (PARTITION BY survey ORDER BY sha256('folds' || chr(0) || object_id), object_id) - 1) % 5 AS INT) AS fold FROM {objects} WHERE survey IS NOT NULL""")
def e5(objects: DataFrame) -> DataFrame:
    return splits.cv_folds(objects.where("survey IS NOT NULL"), "survey", 5, "folds")


@query("e6_expand_sample", "objects", sql="""
WITH fixed AS (SELECT object_id, survey FROM {objects} WHERE survey IN ('en', 'fr') AND CAST(object_id AS BIGINT) < 15),
need AS (SELECT t.label, t.n - count(fixed.survey) AS k FROM (VALUES ('en', 20), ('fr', 15)) AS t(label, n) LEFT JOIN fixed ON survey = label GROUP BY t.label, t.n),
more AS (SELECT o.object_id, o.survey FROM {objects} o JOIN need ON label = survey WHERE o.object_id NOT IN (SELECT object_id FROM fixed) QUALIFY row_number() OVER (PARTITION BY survey ORDER BY sha256(concat('42:', o.object_id)), o.object_id) <= any_value(k))
SELECT object_id, survey, sha256(concat('42:order:', object_id)) AS draw FROM (SELECT * FROM fixed UNION ALL SELECT * FROM more)""".replace("any_value(k)", "k"))
def e6(objects: DataFrame) -> DataFrame:
    some = objects.where("survey IN ('en', 'fr')").select("object_id", "survey")
    return splits.expand_sample(some.where("CAST(object_id AS BIGINT) < 15"), some, "survey", {"en": 20, "fr": 15})


@query("e7_review_sample", "objects", sql=f"""
WITH t AS (SELECT object_id, {TIER} AS kind FROM {{objects}}) SELECT object_id, kind FROM t QUALIFY row_number() OVER (PARTITION BY kind ORDER BY {DRAW}, object_id) <= 25""")
def e7(objects: DataFrame) -> DataFrame:
    return splits.review_sample(clean.with_tier(clean.availability_flags(objects)), F.col("tier"), 25).select("object_id", "kind")


INPUTS["subsets"] = "SELECT object_id, s.subset, s.weight FROM {objects} CROSS JOIN (SELECT 'image' AS subset, 2e0 AS weight UNION ALL SELECT 'image+spectra' AS subset, 5e0 AS weight UNION ALL SELECT 'spectra' AS subset, 3e0 AS weight) s"


def _uniform(key: str) -> str:
    return f"CAST('0x' || substr(sha256(concat({key}, ':', object_id)), 1, 12) AS BIGINT) / 281474976710656.0"


@query("e8_sample_subset", "subsets", sql=f"""
WITH u AS (SELECT * FROM {{subsets}} WHERE NOT (CAST(object_id AS BIGINT) % 3 = 0 AND subset = 'spectra') AND CAST(object_id AS BIGINT) % 10 <> 0),
r AS (SELECT *, sum(weight) OVER (PARTITION BY object_id ORDER BY subset) AS cum, sum(weight) OVER (PARTITION BY object_id) AS total FROM u)
SELECT object_id, min(subset) AS subset FROM r WHERE cum > {_uniform("'42:3'")} * total GROUP BY object_id""")
def e8(subsets: DataFrame) -> DataFrame:
    have = subsets.where("NOT (CAST(object_id AS BIGINT) % 3 = 0 AND subset = 'spectra')").select("object_id", "subset")
    told = subsets.where("CAST(object_id AS BIGINT) % 10 <> 0").select("object_id", "subset")
    return splits.sample_subset(have, told, subsets.select("subset", "weight").distinct(), 3)


@query("e8_dropped", "subsets", sql="""
WITH a AS (SELECT * FROM {subsets} WHERE NOT (CAST(object_id AS BIGINT) % 3 = 0 AND subset = 'spectra')), u AS (SELECT DISTINCT object_id FROM a WHERE CAST(object_id AS BIGINT) % 10 <> 0)
SELECT count(*) AS n_objects, count(u.object_id) AS n_usable, count(*) - count(u.object_id) AS n_dropped FROM (SELECT DISTINCT object_id FROM a) a LEFT JOIN u USING (object_id)""")
def e8_dropped(subsets: DataFrame) -> DataFrame:
    have = subsets.where("NOT (CAST(object_id AS BIGINT) % 3 = 0 AND subset = 'spectra')").select("object_id", "subset")
    told = subsets.where("CAST(object_id AS BIGINT) % 10 <> 0").select("object_id", "subset")
    return splits.subset_report(have, told, subsets.select("subset", "weight").distinct())


@query("e9_sample_prompts", "objects", sql=f"""
SELECT object_id, replace(CASE CAST(floor({_uniform("'42:1:prompt'")} * 2) AS INT) WHEN 0 THEN 'Describe the {{modalities}}.' ELSE 'What does the {{modalities}} show?' END, '{{modalities}}', survey) AS prompt FROM {{objects}} WHERE survey IS NOT NULL""".replace("{modalities}", "[modalities]"))
def e9(objects: DataFrame) -> DataFrame:
    out = splits.sample_prompts(objects.where("survey IS NOT NULL"), ["Describe the {modalities}.", "What does the {modalities} show?"], 1, F.col("survey"))
    return out


@query("e10_gaps", "points", sql="""
WITH s AS (SELECT object_id, row_number() OVER w - 1 AS gap_pos, lag(mjd) OVER w AS a, mjd AS b FROM {points} WHERE used WINDOW w AS (PARTITION BY object_id ORDER BY mjd, pos))
SELECT object_id, CAST(gap_pos AS INT) AS gap_pos, round(a, 6) AS start_days, round(b, 6) AS end_days, round(b - a, 6) AS days FROM s WHERE a IS NOT NULL""")
def e10(points: DataFrame) -> DataFrame:
    g = splits.gaps(points.where("used"), "object_id", "mjd", "pos")
    return g.select("object_id", "gap_pos", F.round("start", 6).alias("start_days"), F.round("end", 6).alias("end_days"), F.round("days", 6).alias("days"))


@query("e11_first_objects", "ledger", sql="SELECT object_id, seq FROM {ledger} QUALIFY dense_rank() OVER (ORDER BY object_id) <= 20")
def e11(ledger: DataFrame) -> DataFrame:
    return splits.first_objects(ledger, "object_id", 20).select("object_id", "seq")


@query("e12_latest_record", "ledger", sql="""
SELECT object_id, seq, status, answer IS NOT NULL AS complete FROM {ledger} QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) = 1""")
def e12(ledger: DataFrame) -> DataFrame:
    last = splits.latest_record(ledger, "object_id", "seq")
    done = splits.completed(ledger, "object_id", "seq", F.col("answer").isNotNull()).withColumn("complete", F.lit(True))
    return last.join(done, "object_id", "left").select("object_id", "seq", "status", F.coalesce("complete", F.lit(False)).alias("complete"))


@query("e13_amortised_runtime", "ledger", sql="SELECT object_id, seq, round(tokens / count(*) OVER (PARTITION BY object_id), 6) AS amortised FROM {ledger}")
def e13(ledger: DataFrame) -> DataFrame:
    return splits.amortised_runtime(ledger, "object_id", "tokens").select("object_id", "seq", F.round("amortised", 6).alias("amortised"))


@query("f2_intersect", "customer", "orders", sql="SELECT c_custkey AS k FROM {customer} INTERSECT SELECT o_custkey FROM {orders}")
def f2(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("k")).intersect(orders.select(F.col("o_custkey").alias("k")))


@query("f3_except", "customer", "orders", sql="SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
def f3(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("k")).exceptAll(orders.select(F.col("o_custkey").alias("k")).distinct())


@query("f1_union_by_name", "customer", "supplier", sql="SELECT c_nationkey AS nation, c_acctbal AS v, c_mktsegment AS segment FROM {customer} UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM {supplier}")
def f1(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    a = customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(supplier.select(F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@query("f4_array_sets", "multi", sql="""
WITH s AS (SELECT sample_id, list_distinct(list(label)) AS a, list_distinct(list(guess)) AS b FROM {multi} GROUP BY sample_id)
SELECT sample_id, CAST(len(list_intersect(a, b)) AS INT) AS n_both, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS n_either, CAST(len(a) - len(list_intersect(a, b)) AS INT) AS n_only FROM s""")
def f4(multi: DataFrame) -> DataFrame:
    s = multi.groupBy("sample_id").agg(F.collect_set("label").alias("a"), F.collect_set("guess").alias("b"))
    return s.select("sample_id", F.size(F.array_intersect("a", "b")).alias("n_both"), F.size(F.array_union("a", "b")).alias("n_either"), F.size(F.array_except("a", "b")).alias("n_only"))


def flagship(spectra: DataFrame, images: DataFrame) -> DataFrame:
    from skyframe.plans.manifest import build_manifest, manifest_balance

    return manifest_balance(build_manifest(spectra, images, val=0.1, test=0.1, strata=("survey",)))


INPUTS["image_catalog"] = "SELECT CAST(p_partkey AS STRING) AS object_id, p_size AS size FROM {part}"


@query("manifest_balance", "catalog_a", "image_catalog", sql="""
WITH m AS (SELECT coalesce(a.object_id, b.object_id) AS object_id, a.survey FROM {catalog_a} a FULL OUTER JOIN {image_catalog} b ON a.object_id = b.object_id),
r AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY sha256(concat('42:', object_id)), object_id) AS i, count(*) OVER (PARTITION BY survey) AS n FROM m),
p AS (SELECT survey, n, CASE WHEN i <= round_even(n * 0.1, 0) THEN 'val' WHEN i <= 2 * round_even(n * 0.1, 0) THEN 'test' ELSE 'train' END AS split FROM r)
SELECT survey, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test,
round(count(*) FILTER (WHERE split = 'train') / count(*), 6) AS train_share, count(*) >= 50 AND count(*) FILTER (WHERE split = 'train') / count(*) < 0.5 AS unbalanced FROM p GROUP BY survey""")
def manifest_balance(catalog: DataFrame, images: DataFrame) -> DataFrame:
    return flagship(catalog.select("object_id", "survey", "dist", "seq", "ra", "dec"), images)


@query("d31_overlap_rate", "customer", "orders", sql="""
WITH b AS (SELECT DISTINCT o_custkey AS k FROM {orders}), a AS (SELECT c_custkey AS k FROM {customer} WHERE c_acctbal > 0)
SELECT count(*) AS n_keys, count(a.k) AS n_found, round(count(a.k) / count(*), 6) AS rate, count(a.k) / count(*) < 0.5 AS low FROM b LEFT JOIN a USING (k)""")
def d31(customer: DataFrame, orders: DataFrame) -> DataFrame:
    out = joins.overlap_rate(customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("object_id")), orders.select(F.col("o_custkey").alias("object_id")))
    return out.withColumn("rate", F.round("rate", 6))
