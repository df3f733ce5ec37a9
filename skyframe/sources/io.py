"""Sources and sinks: Parquet, JSON lines, JSON documents, CSV, ledgers, caches, frozen inputs.

Reads have fixed schemas, so columns are pruned at the scan and types don't depend on the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.columns import fingerprint, strip
from skyframe.operators.checks import ValidationError, leaking_claims, not_unique, require_empty
from skyframe.operators.lineage import settled
from skyframe.operators.splits import review_sample


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def discover(spark: SparkSession, prefix: str, fallback: str | None = None, suffix: str = ".parquet") -> list[str]:
    """Files below a prefix, else below the fallback; none is an error. The listing is Hadoop's, so any store works."""
    for root in filter(None, (prefix, fallback)):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            found = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))
            if found:
                return found
    raise FileNotFoundError(f"no {suffix} below {prefix} or {fallback}")


def read_parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only these columns (nested ones too) leave the files."""
    return spark.read.parquet(path).select(*columns)


def read_union(spark: SparkSession, paths: list[str], key: str = "object_id", rank: str = "src_rank") -> DataFrame:
    """Files with different columns, and different types of the id, as one table; ``rank`` is the file's place in the list."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.parquet(path)
        one = one.withColumn(key, F.col(key).cast("string")).withColumn(rank, F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no paths")
    return out


def tag_survey(df: DataFrame, surveys: list[str], file_name: str = "_file", column: str | None = "survey") -> DataFrame:
    """``survey`` from a file name that holds exactly one survey, else from the lower-case column; null or unknown is an error."""
    name = F.lower(file_name)
    hits = sum((F.contains(name, F.lit(s)).cast("int") for s in surveys), F.lit(0))
    from_name = F.coalesce(*[F.when(F.contains(name, F.lit(s)), s) for s in surveys])
    from_row = F.lower(strip(F.col(column))) if column in df.columns else F.lit(None).cast("string")
    out = df.withColumn("survey", F.when(hits == 1, from_name).otherwise(from_row))
    bad = out.where(F.col("survey").isNull() | ~F.col("survey").isin(surveys)).limit(1).count()
    if bad:
        raise ValidationError("rows without a known survey")
    return out


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): lines of text files; ``block`` is where the split begins, ``place`` orders a split's lines."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def numbered_lines(lines: DataFrame, all_lines: DataFrame) -> DataFrame:
    """``lines`` with ``line``: the number from 1 in its file, whatever splits the file is read in.

    Lines are counted by split; the splits before a line's own and its place in the own one give the number, so no file
    is ever in one task. ``all_lines`` are all of :func:`text_lines`, of which ``lines`` are some.
    """
    splits = all_lines.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    # A row for each split of a file.
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")
    starts = splits.select("file", "block", "_first", before.alias("_before"))
    return lines.join(starts, ["file", "block"]).withColumn("line", F.col("_before") + F.col("place") - F.col("_first") + 1).drop("_before", "_first")


#: Fixed value: what a captioner writes where a spectrum says too little.
INSUFFICIENT = "INSUFFICIENT_SPECTRAL_DATA"


def read_caption_jsonl(spark: SparkSession, path: str, sentinel: str = INSUFFICIENT) -> tuple[DataFrame, DataFrame]:
    """((object_key, caption), (status, n)): usable captions with keys and texts trimmed, and lines by status.

    A line is ``insufficient`` by its flag or the sentinel, ``missing`` without an output, key or caption, a ``duplicate`` if
    it repeats a usable one, else ``usable``; blank lines don't count. Invalid JSON, a line or output that is no object, a
    caption that is no text and a second caption for a key are errors, named by file and line in the order of the lines.
    """
    lines = text_lines(spark, path)
    said = lines.where(strip(F.col("value")) != "").withColumn("_v", F.try_parse_json("value"))
    part = lambda field: F.try_variant_get("_v", field, "variant")
    kind = lambda v: F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID"))
    rows = said.withColumns({"_output": part("$.output"), "_key": part("$.object_key"), "_caption": part("$.output.caption"), "_flag": part("$.output.is_insufficient")})
    rows = rows.withColumns({f"_k{c}": kind(F.col(c)) for c in ("_v", "_output", "_key", "_caption", "_flag")})
    text = lambda c: F.when(F.col(f"_k{c}") == "STRING", F.try_variant_get(c, "$", "string"))
    rows = rows.withColumns({"_text": text("_caption"), "object_key": strip(text("_key"))})
    raised = F.when(F.col("_k_flag") == "BOOLEAN", F.try_variant_get("_flag", "$", "boolean")).when(F.col("_k_flag") == "VOID", False).otherwise(~F.to_json("_flag").isin("0", "0.0", '""', "[]", "{}"))
    status = (
        F.when(F.col("_v").isNull(), "invalid JSON")
        .when(F.col("_k_v") != "OBJECT", "no object")
        .when(F.col("_k_output") == "VOID", "missing")
        .when(F.col("_k_output") != "OBJECT", "output is no object")
        .when(F.coalesce(raised, F.lit(False)) | F.coalesce(F.col("_text") == sentinel, F.lit(False)), "insufficient")
        .when((F.coalesce("object_key", F.lit("")) == "") | (F.col("_k_caption") == "VOID"), "missing")
        .when(F.col("_k_caption") != "STRING", "caption is no text")
        .when(strip(F.col("_text")) == "", "missing")
        .when(strip(F.col("_text")) == sentinel, "insufficient")
        .otherwise("usable")
    )
    rows = settled(rows.select("file", "block", "place", status.alias("status"), "object_key", strip(F.col("_text")).alias("caption")))
    usable = rows.where("status = 'usable'")
    several = usable.groupBy("object_key").agg(F.count_distinct("caption").alias("n")).where("n > 1").select("object_key")
    bad = rows.where(~F.col("status").isin("missing", "insufficient", "usable"))
    if several.limit(1).count() or bad.limit(1).count():
        # Only now are lines numbered: the first of a conflicting key is right, the first that differs from it isn't.
        mine = numbered_lines(usable.join(several, "object_key"), lines)
        first = mine.groupBy("object_key").agg(F.min_by("caption", F.struct("file", "line")).alias("_first"))
        conflicts = mine.join(first, "object_key").where("caption <> _first").select("file", "line", F.concat(F.lit("second caption for "), "object_key").alias("status"))
        wrong = numbered_lines(bad, lines).select("file", "line", "status").unionByName(conflicts)
        told = [f"{r['file']}:{r['line']}: {r['status']}" for r in wrong.orderBy("file", "line").limit(3).collect()]
        raise ValidationError("; ".join(told))
    captions = usable.select("object_key", "caption").distinct()
    counts = rows.groupBy("status").agg(F.count("*").alias("n"))
    once = captions.agg(F.count("*").alias("_k"))
    repeats = counts.where("status = 'usable'").join(once, how="cross")  # single rows
    split = repeats.select(F.explode(F.array(F.struct(F.lit("usable").alias("status"), F.col("_k").alias("n")), F.struct(F.lit("duplicate").alias("status"), (F.col("n") - F.col("_k")).alias("n")))).alias("x")).select("x.*").where("n > 0")
    return captions, counts.where("status <> 'usable'").unionByName(split)


#: Objects and lists under a field of type string are read as their JSON text.
PREDICTION_SCHEMA = """sample_id string, object_id string, survey string, task string, regime string, ground_truth string, prediction string,
caption struct<text string, responder_type string, model_id string>, candidate_query_lines array<string>,
frontier_evaluation struct<frontier_model string, prompt string, raw_response string, parsed_successfully boolean, prediction string, is_correct boolean, forced_fallback boolean>"""


def read_predictions(spark: SparkSession, path: str, valid: DataFrame | None = None) -> DataFrame:
    """Predictions by sample_id (or object_id); the last line of an id wins.

    ``prediction`` is that of the evaluation where a record has one, else its own. A list is also given as
    ``predicted_lines``, and a ground truth that maps lines to numbers as ``truth_lines``; else these are null.
    Lines are ordered by file, block and place in the block, so the order is that of the text.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    rows = raw.select(F.from_json("value", PREDICTION_SCHEMA).alias("r"), "_f", "_b", "_i").select("r.*", "_f", "_b", "_i").withColumn("sample_id", F.coalesce("sample_id", "object_id")).drop("object_id")
    rows = rows.withColumn("prediction", F.coalesce("frontier_evaluation.prediction", "prediction"))
    rows = rows.withColumn("predicted_lines", F.when(F.col("prediction").startswith("["), F.from_json("prediction", "array<string>")))
    rows = rows.withColumn("truth_lines", F.when(F.col("ground_truth").startswith("{"), F.from_json("ground_truth", "map<string,double>")))
    last = Window.partitionBy("sample_id").orderBy(F.desc("_f"), F.desc("_b"), F.desc("_i"))
    out = rows.where("sample_id IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_f", "_b", "_i")
    return out if valid is None else out.join(valid.select("sample_id"), "sample_id", "left_semi")


def read_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with a header and an ``objects`` array: a row per object, header columns kept.

    A file holds one document; Spark doesn't read what follows it in the same file.
    """
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select(*[c for c in doc.columns if c != "objects"], F.explode("objects").alias("o")).select("*", "o.*").drop("o")


def read_line_metadata(spark: SparkSession, types_path: str, lines_path: str) -> tuple[DataFrame, DataFrame]:
    """((wiki_entity_id, class, subclass) with the first row of each id in file order, (wiki_entity_id, LINE_NAME, SNR)).

    Columns are found by the names in the header; others are left out.
    """
    types = spark.read.option("header", True).csv(types_path)
    lost = [c for c in ("wiki_entity_id", "class", "subclass") if c not in types.columns]
    if lost:
        raise ValidationError(f"{types_path} lacks columns {lost}")
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    first = types.select("wiki_entity_id", F.struct("class", "subclass").alias("_r"), order.alias("_at")).groupBy("wiki_entity_id").agg(F.min_by("_r", "_at").alias("_r"))
    lines = spark.read.option("header", True).csv(lines_path).select("wiki_entity_id", "LINE_NAME", F.col("SNR").cast("double").alias("SNR"))
    return first.select("wiki_entity_id", "_r.class", "_r.subclass"), lines


def read_context_jsonl(spark: SparkSession, path: str, longest: int = 25_000) -> DataFrame:
    """(object_id, context); blank, repeated or too long contexts are an error."""
    from skyframe.operators.checks import bad_texts

    rows = spark.read.schema("object_id string, context string").json(path)
    require_empty(bad_texts(rows, "object_id", "context", longest), "bad context")
    return rows


#: What every benchmark has, and the keys of each benchmark's ground truth.
BENCHMARK_COLUMNS = ("survey", "spectrum", "ground_truth")
BENCHMARKS: dict[str, tuple[str, ...]] = {
    "redshift": ("z", "redshift_bin"),
    "source_class": ("source_class",),
    "subclass": ("subclass",),
    "emission_lines": ("detected_lines", "absent_lines"),
}


def register_benchmark(name: str, truth_keys: tuple[str, ...]) -> None:
    """Make a benchmark known by name, with the keys that its ground truth must have."""
    BENCHMARKS[name] = tuple(truth_keys)


def load_benchmark(spark: SparkSession, name: str, path: str, required: tuple[str, ...] = BENCHMARK_COLUMNS) -> DataFrame:
    """A known benchmark with sample ids as text, from object_id where there is no sample_id.

    An unknown name, a missing column, a ground truth (a struct or a map) without one of its keys and repeated samples are
    errors.
    """
    if name not in BENCHMARKS:
        raise ValidationError(f"unknown benchmark {name}; known are {sorted(BENCHMARKS)}")
    df = spark.read.parquet(path)
    if "sample_id" not in df.columns:
        if "object_id" not in df.columns:
            raise ValidationError(f"benchmark {name} has neither sample_id nor object_id")
        df = df.withColumn("sample_id", F.col("object_id"))
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValidationError(f"benchmark {name} lacks {lost}")
    out = df.withColumn("sample_id", F.col("sample_id").cast("string"))
    if "ground_truth" in df.columns:
        kind = df.schema["ground_truth"].dataType
        if isinstance(kind, T.StructType):
            lost = [k for k in BENCHMARKS[name] if k not in kind.fieldNames()]
            if lost:
                raise ValidationError(f"the ground truth of {name} lacks {lost}")
        elif isinstance(kind, T.MapType):
            missing = F.array_except(F.array(*[F.lit(k) for k in BENCHMARKS[name]]), F.map_keys("ground_truth"))
            require_empty(out.where(F.size(missing) > 0).select("sample_id", missing.alias("missing")), f"ground truths of {name} without a key")
    require_empty(not_unique(out, "sample_id"), f"benchmark {name} has repeated samples")
    return out


def load_all_unique(benchmarks: list[DataFrame], key: str = "sample_id") -> DataFrame:
    """Common columns of all benchmarks; the first benchmark in the list wins a sample."""
    common = [c for c in benchmarks[0].columns if all(c in b.columns for b in benchmarks)]
    out = None
    for i, b in enumerate(benchmarks):
        one = b.select(*common).withColumn("_src", F.lit(i))
        out = one if out is None else out.unionByName(one)
    first = Window.partitionBy(key).orderBy("_src")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumnRenamed("_src", "src_rank")


def write_manifest(df: DataFrame, path: str, least: int = 50, upstream: str = "split_upstream", honoured: bool = True) -> DataFrame:
    """Write a manifest with tiers and splits to ``path/table``, and its statistics to ``path/stats`` as one JSON record.

    An empty train or test is an error, before anything is written. The statistics: rows, histograms of tiers, splits
    and given splits, whether splits follow the given ones, and tiers with fewer than ``least`` objects. Returns them as
    one row.
    """
    given = upstream in df.columns
    counts = df.groupBy("tier", "split", F.col(upstream).cast("string").alias("_given") if given else F.lit(None).cast("string").alias("_given")).agg(F.count("*").alias("n")).collect()  # a row for each tier and split
    total = {c: {} for c in ("tier", "split", "_given")}
    for r in counts:
        for c, seen in total.items():
            if r[c] is not None:
                seen[r[c]] = seen.get(r[c], 0) + r["n"]
    lost = [s for s in ("train", "test") if not total["split"].get(s)]
    if lost:
        raise ValidationError(f"splits {lost} are empty: {total['split']}")
    labelled = sum(total["_given"].values()) if honoured else 0
    thin = sorted(t for t, n in total["tier"].items() if n < least)
    record = (sum(total["split"].values()), total["tier"], total["split"], "upstream+seeded_draw" if labelled else "seeded_draw", labelled, total["_given"] if labelled else {}, thin)
    stats = df.sparkSession.createDataFrame([record], "n_objects long, tier_histogram map<string,long>, split_histogram map<string,long>, split_source string, n_upstream_labelled_objects long, upstream_split_histogram map<string,long>, thin_tiers array<string>")
    df.write.mode("errorifexists").parquet(f"{path}/table")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return stats


def write_captions(captions: DataFrame, path: str, report: DataFrame, key: str = "object_id", subset: str = "subset", claims: str = "claims", sample: int = 25, seed: int = 0) -> DataFrame:
    """Write captions, a one-row report and a sample to read to ``path/captions``, ``path/report`` and ``path/review``.

    The sample holds up to ``sample`` captions of a single modality and as many of several. The report gets the number of
    claims outside their caption's subset. All three are written even if there are such claims, so that one can look at
    them; then the gate fails.
    """
    spark = captions.sparkSession
    leaks = leaking_claims(captions, key, subset, claims)
    n_leaks = leaks.count()
    captions.write.mode("errorifexists").parquet(f"{path}/captions")
    out = spark.read.schema(captions.schema).parquet(f"{path}/captions")
    report.withColumn("n_leakage_violations", F.lit(n_leaks)).coalesce(1).write.mode("overwrite").json(f"{path}/report")
    kind = F.when(F.size(subset) > 1, "joint").otherwise("single")
    chosen = review_sample(out, kind, sample, seed, key).select(key, subset, "text")
    chosen.coalesce(1).write.mode("overwrite").json(f"{path}/review")  # twice ``sample`` rows
    if n_leaks:
        raise ValidationError(f"{n_leaks} claims outside their caption's subset: {[tuple(r) for r in leaks.limit(3).collect()]}")
    return out


def replace_report(report: DataFrame, path: str) -> None:
    """The whole report, swapped in by Spark's commit."""
    report.coalesce(1).write.mode("overwrite").json(path)


def export_summary_csv(results: DataFrame, tasks: list[str], path: str) -> DataFrame:
    """Wide model by task table with four decimals, as one CSV file; returns the table."""
    wide = results.groupBy("model").pivot("task", tasks).agg(F.format_string("%.4f", F.first("score")))
    wide.orderBy("model").coalesce(1).write.mode("overwrite").csv(path, header=True)  # a row for each model
    return wide


def export_comparisons_csv(comparisons: DataFrame, path: str, target: str, metrics: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``compare_all`` as one CSV file of the stated columns; ``metrics`` names the metric of tasks other than accuracy.

    Scores have four decimals, differences a sign too.
    """
    named = F.coalesce(*[F.when(F.col("task") == t, m) for t, m in (metrics or {}).items()], F.lit("accuracy"))
    plain, signed = (lambda c: F.format_string("%.4f", F.col(c))), (lambda c: F.format_string("%+.4f", F.col(c)))
    # Names and order of the columns.
    columns = {
        "model_id": F.lit(target), "baseline_model": F.col("model"), "task": F.col("task"), "regime": F.col("regime"), "metric": named, "num_samples": F.col("n"),
        "score_baseline": plain("base"), "ci_baseline_lower": plain("base_low"), "ci_baseline_upper": plain("base_high"),
        "score_model": plain("treatment"), "ci_model_lower": plain("treatment_low"), "ci_model_upper": plain("treatment_high"),
        "delta_observed": signed("delta"), "ci_delta_lower": signed("delta_low"), "ci_delta_upper": signed("delta_high"),
        "p_value": plain("p_value"), "is_significant": F.when(F.col("p_value") < 0.05, "True").otherwise("False"),
    }
    out = comparisons.select(*[c.alias(n) for n, c in columns.items()])
    out.orderBy("baseline_model", "task", "regime").coalesce(1).write.mode("overwrite").csv(path, header=True)  # a row for each model, task and regime
    return out


def freeze_inputs(df: DataFrame, path: str, contract: str, key: str, rendered: str) -> DataFrame:
    """An immutable snapshot with input hashes and a contract; an existing one is reused only if contract and counts agree."""
    spark = df.sparkSession
    snapshot = df.withColumn("input_sha256", F.sha2(F.col(rendered), 256)).withColumn("contract", F.lit(contract))
    if exists(spark, path):
        old = spark.read.parquet(path)
        a = old.agg(F.count("*"), F.min("contract"), F.max("contract")).first()
        if tuple(a) != (df.count(), contract, contract):
            raise ValidationError("the snapshot was made under another contract")
        return old
    require_empty(not_unique(snapshot, key), "repeated ids")
    snapshot.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def row_print(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a ``row_sha256`` over columns in the order of their names."""
    return df.withColumn("row_sha256", fingerprint(*sorted(columns)))
