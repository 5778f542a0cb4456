"""Results that later runs add to, and order statistics, against plain programs."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import collapse, forward

DATA = "/root/testdata/sf0.001"


def plain_greedy(nodes, links, cover):
    near = {n: {a for a, b, c in links if b == n and c >= cover and a != n and a in nodes} for n in nodes}
    centroid = {}
    while len(centroid) < len(nodes):
        n = max((x for x in nodes if x not in centroid), key=lambda x: (sum(m not in centroid for m in near[x]), -x))
        centroid[n] = n
        for m in near[n]:
            centroid.setdefault(m, n)
    return centroid


def plain_extend(known, nodes, links, cover):
    """{node: (centroid, cluster, how)}; nodes are their own ord."""
    out = {n: (c, k, "kept") for n, (c, k, *_) in known.items()}
    rest = set()
    for n in nodes - set(known):
        options = [(-v, known[b][1], b) for a, b, v in links if a == n and v >= cover and b in known and known[b][0] == b]
        if options:
            _, k, b = min(options)
            out[n] = (b, k, "joined")
        else:
            rest.add(n)
    found = plain_greedy(rest, [x for x in links if x[0] in rest and x[1] in rest], cover)
    numbers = {c: i for i, c in enumerate(sorted(set(found.values())), max((k for _, k in (v[:2] for v in known.values())), default=0) + 1)}
    return out | {n: (c, numbers[c], "new") for n, c in found.items()}


def test_extend(spark):
    rng = random.Random(4)
    links = list({(a, b): (a, b, rng.choice([0.5, 0.9, 0.95, 1.0])) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a != b}.values())
    table = spark.createDataFrame(links, "node long, other long, cover double")
    frame = lambda ns: spark.createDataFrame([(n, n, 1) for n in ns], "node long, ord long, len long")
    known, expected = None, {}
    for last in (25, 40, 40, 60):
        before = known
        known = forward.extend(known, frame(range(last)), table)
        expected = plain_extend(expected, set(range(last)), links, 0.9)
        assert {r.node: (r.centroid, r.cluster, r.how) for r in known.collect()} == expected
    heads = {c: k for n, (c, k, _) in {r.node: (r.centroid, r.cluster, 0) for r in before.collect()}.items() if n == c}
    bridged = {n: sorted({heads[b] for a, b, v in links if a == n and v >= 0.9 and b in heads}) for n in expected if expected[n][2] != "kept"}
    assert {r.node: r.clusters for r in forward.bridges(before, known, table).collect()} == {n: c for n, c in bridged.items() if len(c) > 1}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_forward_clusters(spark):
    """The registered query: two batches, three levels."""
    from seqloom import queries_growth
    from seqloom.queries import _links

    parts = spark.read.parquet(f"{DATA}/part.parquet").collect()
    links = [(r.node, r.other, r.cover) for r in _links(spark, DATA).collect()]
    known = {}
    for batch in ({r.p_partkey for r in parts if r.p_size < 25}, {r.p_partkey for r in parts}):
        at = batch
        for level, cover in enumerate((0.9, 0.6, 0.3)):
            known[level] = plain_extend(known.get(level, {}), at, [x for x in links if x[0] in at and x[1] in at | set(known.get(level, {}))], cover)
            at = batch & {n for n, v in known[level].items() if v[0] == n}
    got = {(r.node, r.level): (r.centroid, r.cluster, r.how) for r in queries_growth.forward_clusters(spark, DATA).collect()}
    assert got == {(n, level): v for level, table in known.items() for n, v in table.items()}


def test_roster_and_overlay(spark):
    rows = spark.createDataFrame([(1, "b", "ac d"), (2, "a", "ACD"), (3, None, "WW"), (4, "x", ""), (5, "y", None), (6, "z", "KK")], "row long, name string, seq string")
    known = spark.createDataFrame([("KK", "old", "C001")], "s string, accession string, label string").withColumn("sequence_md5", F.md5("s"))
    nodes, placed = forward.roster(rows, known, "row", "name", "seq")
    assert {(r.accession, r.label, r.is_new) for r in nodes.collect()} == {("old", "C001", False), ("a", None, True), ("file:" + nodes.where("accession like 'file:%'").first().sequence_md5[:8], None, True)}
    assert {(r.row, r.length, r.is_new) for r in placed.collect()} == {(1, 3, True), (2, 3, True), (3, 2, True), (6, 2, False)}
    assert forward.agreeing(rows, "name", "seq").count() == 0 and forward.agreeing(rows.withColumn("k", F.lit(1)), "k", "seq").count() == 1
    out = forward.overlaid(rows, spark.createDataFrame([(1, "ACD"), (3, "WY"), (4, "MM"), (5, "-")], "row long, seq string"), "row", "seq")
    assert {r.row: (r.seq, r.outcome) for r in out.collect()} == {1: ("ACD", "same"), 2: ("ACD", "own"), 3: ("WY", "revised"), 4: ("MM", "rescued"), 5: ("", "own"), 6: ("KK", "own")}


def test_lookups_are_made_once(spark):
    asked = []

    def fetch(answers):
        def run(wanted):
            keys = {r.k for r in wanted.collect()}
            asked.append(keys)
            return spark.createDataFrame([(k, s, a) for k, s, a in answers if k in keys], "k string, status string, answer string")

        return run

    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    store = forward.looked_up(None, keys("a", "b", "c", "a", None), "k", fetch([("a", "found", "1"), ("b", "failed", None)]))
    store = forward.looked_up(store, keys("a", "b", "c", "d"), "k", fetch([("b", "failed", None), ("b", "found", "2"), ("d", "failed", None)]))
    store = forward.looked_up(store, keys("a", "b", "c"), "k", fetch([]))
    assert asked == [{"a", "b", "c"}, {"b", "d"}, set()]
    assert {r.key: (r.status, r.answer) for r in store.collect()} == {"a": ("found", "1"), "b": ("found", "2"), "c": ("empty", None), "d": ("failed", None)}
    assert all(len(r.digest) == 24 for r in store.collect())


@pytest.mark.parametrize("kind", ["long", "double", "decimal(12,2)"])
def test_order_statistics(spark, monkeypatch, kind):
    monkeypatch.setattr(collapse, "PARTS", 7)
    rng = random.Random(9)
    groups = {"ties": [1, 1, 1, 2, 2], "one": [5], "same": [3] * 40, "wide": [rng.randrange(-(10**9), 10**9) for _ in range(500)], "skew": [0] * 30 + [10**8, -(10**8)], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long").withColumn("v", F.col("v").cast(kind))
    for place, at in ((F.floor(F.col("n") / 2), lambda n: n // 2), (F.lit(0), lambda n: 0), (F.col("n") - 1, lambda n: n - 1)):
        got = {r.g: int(r.value) for r in collapse.order_statistic(df, "v", place, ["g"]).collect()}
        assert got == {g: sorted(vs)[at(len(vs))] for g, vs in groups.items() if vs}
    whole = sorted(v for vs in groups.values() for v in vs)
    assert int(collapse.upper_median_of(df, "v").first().upper_median) == whole[len(whole) // 2]


def test_order_statistic_of_odd_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (math.nan, 1.5, -math.inf, math.nan, 2.5, 1e308, -1e308)], "v double")
    got = [collapse.order_statistic(df.where("v > double('-Infinity')"), "v", F.lit(i)).first().value for i in range(6)]
    assert got[:4] == [-1e308, 1.5, 2.5, 1e308] and all(map(math.isnan, got[4:]))
    assert collapse.order_statistic(df.where("v is null"), "v", F.lit(0)).count() == 0


def test_merged_summaries_equal_the_whole(spark):
    from seqloom.operators import summaries

    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randrange(4), rng.choice([None, 1.0, 2.5]), rng.choice([None, "a", "b", "c"])) for _ in range(200)], "g long, x double, v string")
    both = summaries.merged(summaries.partial(df.where("v = 'a'"), ["g"], ["x"], ["v"]), summaries.partial(df.where("v is null or v <> 'a'"), ["g"], ["x"], ["v"]), ["g"])
    one, two = (sorted(map(tuple, summaries.finished(p, ["g"], ["x"], ["v"]).collect()), key=str) for p in (both, summaries.partial(df, ["g"], ["x"], ["v"])))
    assert one == two and all(r[-1] == 3 for r in one)


def test_index_reads_few_rows(spark, tmp_path, monkeypatch):
    from seqloom.operators import summaries
    from seqloom.sources.versions import current

    monkeypatch.setattr(summaries, "SPAN", 64)
    path = f"file://{tmp_path}/index"
    df = spark.range(1000).select("id", F.concat(F.lit("Every row, t"), (F.col("id") % 50), F.lit(" u"), "id").alias("text"))
    summaries.write_index(df.unionByName(df.limit(5)), "id", "text", path)
    assert {r.row for r in summaries.find_terms(spark, path, ["every", "T7"]).collect()} == set(range(7, 1000, 50))
    assert summaries.find_terms(spark, path, ["t7", "t8"]).count() == 0 and summaries.find_terms(spark, path, ["t7", "t8"], every=False).count() == 40
    assert {(r.term, r.row) for r in summaries.find_prefix(spark, path, "U99").collect()} == {(f"u{i}", i) for i in (99, *range(990, 1000))}
    index = spark.read.parquet(current(spark, path))
    assert index.where("term = 'every'").count() == 16 and index.agg(F.max("n")).first()[0] <= 64
    assert "GreaterThanOrEqual(term,u99)" in summaries.find_prefix(spark, path, "u99")._jdf.queryExecution().executedPlan().toString()
    # terms are dealt by range: a term's lists lie in neighbouring files, all others are pruned by their statistics
    files = index.select("term", F.col("_metadata.file_name").alias("f")).groupBy("f").agg(F.min("term").alias("lo"), F.max("term").alias("hi")).collect()
    assert sum(r.lo <= "t7" <= r.hi for r in files) <= 2


def test_change_audit_similarity(spark):
    import difflib

    from seqloom.operators import evidence

    before, after = (spark.createDataFrame(list(enumerate(x)), "k long, v string") for x in (["abcd", "same", None, "MKVL"], ["abxd", "same", "new", ""]))
    got = {r.k: (r.delta, r.similarity) for r in evidence.change_audit(before, after, "k", "v", similarity=True).collect()}
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), 4)
    assert got == {0: (0, ratio("abcd", "abxd")), 2: (3, ratio("", "new")), 3: (-4, ratio("MKVL", ""))}


def test_containment_shuffles_a_sample(spark, monkeypatch):
    """Long texts are exchanged by a sample of their pieces, short ones by all theirs; no link is lost."""
    import random

    from seqloom.operators import relate, variants
    from seqloom.plans.scratch import materialize

    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    longs = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(30)]
    texts = [*longs]
    for t in longs:
        w = t.split(" ")
        texts += [" ".join(w[k : k + n])[cut:] for n, k, cut in ((1, 5, 0), (2, 7, 1), (3, 9, 1), (4, 20, 0), (7, 30, 1), (150, 40, 1), (299, 1, 0))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    written = {}

    def kept(frame, name):
        written[name] = materialize(frame, name)
        return written[name]

    monkeypatch.setattr(relate, "materialize", kept)
    places = relate.containment_places(df, df, "id", "text", "id", "text")
    got = {(r.short_id, r.long_id): (r.place, r.delta) for r in places.collect()}
    place = lambda s, t: "prefix" if t.startswith(s) else "suffix" if t.endswith(s) else "internal"
    expected = {(i, j): (place(s, t), len(t) - len(s)) for i, s in enumerate(texts) for j, t in enumerate(texts) if s and len(s) < len(t) and s in t}
    assert got == expected
    assert dict(written["held"].dtypes)["piece"] == "bigint"  # numbers are exchanged, not texts
    able = written["pieces"].where("sampled")
    assert able.count() and able.where(f"pmod(piece, {relate.SAMPLE}) <> 0").isEmpty()
    for piece_limit in (0, 10**6):  # without and with a broadcast of the rare pieces
        monkeypatch.setattr(relate, "BROADCAST_PIECES", piece_limit)
        links = relate.containment(df, df, "id", "text", "id", "text")
        assert {(r.short_id, r.long_id) for r in links.collect()} == set(expected)
    groups = variants.substring_groups(df, "id", "text", links, "short_id", "long_id").collect()
    assert {r.id for r in groups} == {i for pair in expected for i in pair}


def test_near_copies_make_no_candidates(spark, monkeypatch):
    """Texts that begin and end alike and differ in the middle, and exact copies, are not compared pair by pair; no link is lost."""
    import random

    from seqloom.operators import relate
    from seqloom.plans.scratch import materialize

    rng = random.Random(12)
    words = [f"w{i}é" for i in range(500)]
    body = [rng.choice(words) for _ in range(400)]
    texts = [" ".join([*body[: 150 + i], "x" * (i + 1), *body[151 + i :]]) for i in range(80)] + [" ".join(body)] * 30
    texts += [" ".join(body[100:140]), texts[3] + " and more", "-" + texts[7], texts[9][5:-5], "y" * 3000, "y" * 2000, "é", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    written = {}

    def kept(frame, name):
        written[name] = materialize(frame, name)
        return written[name]

    monkeypatch.setattr(relate, "materialize", kept)
    got = {(r.short_id, r.long_id) for r in relate.containment(df, df, "id", "text", "id", "text").collect()}
    assert got == {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if s and t and len(s) < len(t) and s in t}
    assert written["candidates"].count() <= len(got) + 100  # those with their change outside both windows


@pytest.mark.parametrize("pieces", [0, 10**6])
def test_containment_at_any_place(spark, monkeypatch, pieces):
    """Parts of every length, cut anywhere, of texts with and without spaces, with a full and with a sparse table of bits."""
    import random

    from seqloom.functions import windows
    from seqloom.operators import relate

    rng = random.Random(13)
    longs = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("ab", 700), ("acgt", 2000), ("aé ", 900), ("abcdefgh ", 3000), ("x", 600), ("0123456789", 300))]
    cuts = [(rng.choice(longs), rng.choice((1, 2, 5, 7, 8, 9, 15, 16, 31, 33, 64, 255, 256, 257, 300, 500))) for _ in range(120)]
    texts = longs + [t[k : k + n] for t, n in cuts for k in [rng.randrange(max(1, len(t) - n))]]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "id string, text string").repartition(3)
    monkeypatch.setattr(relate, "BROADCAST_PIECES", pieces)
    monkeypatch.setattr(windows, "SEGMENT", 1000)
    got = {(r.short_id, r.long_id) for r in relate.containment(df, df, "id", "text", "id", "text").collect()}
    assert got == {(f"k{i}", f"k{j}") for i, s in enumerate(texts) for j, t in enumerate(texts) if len(s) < len(t) and s in t}


@pytest.mark.parametrize("size", [7, 60, 10**6])
def test_covers_in_batches(spark, size, monkeypatch):
    """One component with many shared members: batches of any size take the nodes that the one order takes, in few rounds."""
    import random

    from seqloom.operators import cluster
    from seqloom.plans.scratch import materialize

    rng = random.Random(size)
    pairs = {(rng.randrange(120), rng.randrange(24)) for _ in range(500)} | {(n, n + 1) for n in range(119)}
    pairs = sorted(x for x in pairs if x[0] != x[1])
    nodes = spark.createDataFrame([(0, n, (n * 37) % 120) for n in range(120)], "root long, node long, ord long")
    links = spark.createDataFrame([(0, *x) for x in pairs], "root long, node long, other long")
    rounds = []

    def kept(frame, name):
        rounds.append(name)
        return materialize(frame, name)

    monkeypatch.setattr(cluster, "materialize", kept)
    got = {r.node: r.centroid for r in cluster._cover_rounds(nodes, links, size).collect()}
    near = {n: {a for a, b in pairs if b == n} for n in range(120)}
    expected = {}
    while len(expected) < 120:
        n = max((x for x in range(120) if x not in expected), key=lambda x: (sum(m not in expected for m in near[x]), -(x * 37 % 120)))
        expected |= {m: n for m in near[n] if m not in expected} | {n: n}
    assert got == expected
    if size == 10**6:
        assert rounds.count("found") == 1


def test_kinds_are_found_once(spark, capsys):
    """Order checks name each entry's kind once, and agree with a plain program."""
    from seqloom.functions import accession

    rows = ["5XFY;WP_000000001.1;OK558825", "zzz;AAA12345", "", None, "P12345; ;x_y", "WP_1;5XFY;P12345;??", "AAA12345"]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, x string")
    out = df.select("i", accession.order_problems("x").alias("p"), accession.reordered("x").alias("r"))
    out.explain(True)
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count("^MGYP") <= 2
    got = {r.i: (r.p, r.r) for r in out.collect()}
    assert got == {
        0: (["out-of-order:WP_000000001.1", "primary-misplaced:WP_000000001.1"], "WP_000000001.1;OK558825;5XFY"),
        1: (["unrecognized:zzz", "primary-misplaced:AAA12345"], "zzz;AAA12345"),
        2: ([], ""),
        3: ([], ""),
        4: ([], "P12345;x_y"),
        5: (["unrecognized:??", "out-of-order:P12345"], "WP_1;??;P12345;5XFY"),
        6: ([], "AAA12345"),
    }


def test_lists_are_checked_in_many_tasks(spark):
    """Rows of one file are dealt before their lists are checked; the report counts rows and ids apart."""
    from seqloom import queries
    from seqloom.operators import shape

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = spark.range(0, 400, 1, 1).selectExpr("nullif(id div 2, 0) as id")
        found = F.array(F.lit("a:x"), F.concat(F.lit("part"), F.spark_partition_id().cast("string")))
        report = {r.kind: (r.n, r.n_rows) for r in shape.order_report(rows, "id", found).collect()}
        assert report.pop("a") == (400, 199)
        assert len(report) == 4 and tuple(map(sum, zip(*report.values()))) == (400, 199)
        if os.path.isdir(DATA):
            assert queries.QUERIES["list_order_check"](spark, DATA).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set(key, before)


def test_names_are_cleaned_once(spark, capsys):
    """The separators of a name are replaced once, not for each surface form."""
    from seqloom.functions import families

    names = ["PpCutA", "PET6 lipase", "alpha/beta hydrolase", "hydrolase", "laccase-like hydrolase", "", None]
    df = spark.createDataFrame(list(enumerate(names)), "i long, x string")
    out = df.select("i", families.families_of_name(F.col("x")).alias("f"))
    out.explain(True)
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count("regexp_replace") == 1
    assert {r.i: r.f for r in out.collect()} == {0: ["cutinase"], 1: ["lipase", "pet_hydrolase"], 2: ["ab_hydrolase"], 3: ["hydrolase"], 4: ["laccase"], 5: [], 6: []}


def test_mean_coverage_is_exact(spark):
    """A mean of exactly 0.7 is not below 0.7, in whatever order its shares come."""
    spans = [3, 3, 3, 3, 3, 6, 7, 7, 7, 7]
    for seed in range(3):
        rng = random.Random(seed)
        rng.shuffle(spans)
        hits = spark.createDataFrame([("m", i, 1.0, 1.0, float(n), 7.0) for i, n in enumerate(spans)], "model string, target long, score double, hmm_from double, hmm_to double, query_length double").repartition(1)
        got = collapse.domain_summary(hits, "model", "target", spark.createDataFrame([("m", 10), ("x", 1)], "model string, n long"), 0.7).collect()
        assert {r.model: (r.detected, r["mean"], r.least, r.flags) for r in got} == {"m": (10, 0.7, 3 / 7, ""), "x": (0, 0.0, 0.0, "undetected=1;low_member_coverage;singleton_model")}


def test_quartiles_without_one_task(spark):
    """Quartiles of groups come from counts of parts, so no task holds a group's values."""
    import numpy as np

    from seqloom import queries

    rng = random.Random(4)
    groups = {g: [round(rng.uniform(-5, 5), 2) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 7), ("d", 40))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    got = {r.g: (r.q1, r.q2) for r in collapse.quantiles(df, "v", {"q1": 0.25, "q2": 0.5}, ["g"]).collect()}
    assert {g: tuple(round(x, 9) for x in q) for g, q in got.items()} == {g: tuple(round(float(np.quantile(vs, s)), 9) for s in (0.25, 0.5)) for g, vs in groups.items()}
    assert "percentile" not in queries.QUERIES["robust_stats"](spark, DATA)._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_quoted_files_grow_in_number(spark, monkeypatch):
    """An input of more parts is written as more files, so no task holds a fixed share of it."""
    from seqloom import queries, queries_files

    written, write = [], queries_files.sinks.write_table
    monkeypatch.setattr(queries_files, "table", lambda spark, d, name: queries.table(spark, d, name).repartition(7))
    monkeypatch.setattr(queries_files.sinks, "write_table", lambda df, *a: (written.append(df.rdd.getNumPartitions()), write(df, *a))[1])
    rows = queries.QUERIES["quoted_scan"](spark, DATA)
    assert written == [7] and rows.count() == queries.table(spark, DATA, "documents").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["forward_clusters", "seeded_clusters"])
def test_clusters_broadcast_no_table_that_grows(spark, monkeypatch, name):
    """Nodes, links, roots and clusters are joined by sorting; only short lists go to the driver: large components, offsets of parts."""
    from seqloom import queries, queries_growth
    from seqloom.operators import cluster, components, forward
    from seqloom.plans.scratch import materialize

    plans = {}

    def kept(frame, name):
        plans.setdefault(name, []).append(frame._jdf.queryExecution().executedPlan().toString())
        return materialize(frame, name)

    for module in (cluster, components, forward, queries_growth):
        monkeypatch.setattr(module, "materialize", kept, raising=False)
    result = queries.QUERIES[name](spark, DATA)
    plans["result"] = [result._jdf.queryExecution().executedPlan().toString()]
    few = {"edges": 0, "roots": 0, "tagged": 0, "sizes": 0, "strong": 0, "seeds": 0, "recruited": 0, "rest": 0, "joined": 0, "fresh": 0, "near": 0, "links": 0}
    assert {k: max(p.count("BroadcastHashJoin") for p in ps) for k, ps in plans.items() if k in few} == {k: 0 for k in plans if k in few}
    # the list of large components, and in 'clusters' and the result the offsets of the numbered parts
    assert all(p.count("BroadcastHashJoin") <= 1 for k, ps in plans.items() if k not in few for p in ps)
