import random
import re

from pyspark.sql import functions as F

from skyframe.llm import components, near_dedup
from skyframe.llm.components import connected_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    seen = set()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        up[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def agrees(df, rows):
    want = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    up = list(range(500))
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: up[x] for x in nodes}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rounds_of_components(spark, monkeypatch):
    """Edges that one round makes stars take one round, also stars of an earlier result with a new edge between leaves."""
    rounds = []
    monkeypatch.setattr(components, "stored", lambda df, label, real=components.stored: rounds.append(label) or real(df, label))
    frame = lambda edges: spark.createDataFrame(edges, "u long, v long")
    first = connected_components(frame([(1, k) for k in range(2, 9)])).collect()
    assert sorted(tuple(r) for r in first) == [(k, 1) for k in range(1, 9)] and len(rounds) == 1
    rounds.clear()
    again = components.stars(frame([(k, 1) for k in range(2, 9)] + [(k, 20) for k in range(21, 25)] + [(5, 23)])).collect()
    assert sorted(tuple(r) for r in again) == [(k, 1) for k in [*range(2, 9), *range(20, 25)]] and len(rounds) <= 3


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    agrees(near_dedup.op2_near_dedup(spark, sf), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_crowded_buckets(spark):
    """Many texts around a shared passage, chains of near copies: buckets larger than ALL_PAIRS."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared, rows = [word() for _ in range(60)], []
    for k in range(120):
        rows.append((k, " ".join(shared + [word() for _ in range(rng.choice([8, 18, 30]))])))
    chain = [word() for _ in range(80)]
    for k in range(200, 240):
        chain[rng.randrange(80)] = word()
        rows.append((k, " ".join(chain)))
    agrees(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_crowded_buckets_that_become_thin(spark):
    """Near copies around a shared text: pass 2 leaves 1 to 8 rows of some crowded buckets outside the largest component."""
    rng = random.Random(32)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(60)]
    rows = [(32_000 + k, " ".join(shared + [word() for _ in range(rng.randrange(7, 14))])) for k in range(40)]
    agrees(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_no_table_through_the_driver(spark, monkeypatch):
    """No join is a broadcast, however small its sides; texts are looked for once in all passes."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared, plans = [word() for _ in range(60)], []
    rows = [(k, " ".join(shared + [word() for _ in range(rng.choice([8, 18, 30]))])) for k in range(120)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (near_dedup, components):
        monkeypatch.setattr(module, "stored", lambda df, label, real=module.stored: plans.append((label, plan(df))) or real(df, label))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    agrees(out, rows)
    labels = [label for label, _ in plans]
    assert "crowds" in labels and labels.count("texts") == 1
    assert [label for label, text in [*plans, ("out", plan(out))] if "Broadcast" in text] == []
    # A round over stored edges shuffles each of its sides once: two joins, their aggregates, and the distinct edges.
    assert max(text.count("Exchange hashpartitioning") for label, text in plans if label == "edges") <= 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One TWO"), (5, "one two"), (6, "one two three"), (8, "x y z w v u " * 9000), (9, "X y z w v u " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit(1)).withColumn("u", F.lit("a"))
    agrees(near_dedup.near_duplicates(docs), rows)
    more = docs.unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    out = near_dedup.near_duplicates(more).collect()
    assert len(out) == 10 and [r["component_id"] for r in out if r["doc_id"] is None] == [None]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_with_several_texts_and_repeated_rows(spark):
    """A document has the links of each of its texts, and keeps a row for each of its rows."""
    base = [f"w{k}" for k in range(40)]
    near = lambda k: " ".join([*base, f"x{k}"])
    rows = [(1, near(1)), (2, near(2)), (2, "b c d e f g h i"), (2, near(2)), (3, "b c d e f g h i"), (4, "nothing of the kind at all")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == [(1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]
