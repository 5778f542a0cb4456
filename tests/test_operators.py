"""Rules that a plain mapping would get wrong."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import accession, align, families, text
from seqloom.operators import cluster, collapse, graph, relate, rules, variants
from seqloom.plans import steps
from seqloom.plans.scratch import materialize
from seqloom.sources import delimited, records, sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_blank_is_not_null(spark):
    assert one(spark, text.sequence_key("x"), None) == ""
    assert one(spark, text.sequence_key("x"), " -* ") == ""
    assert one(spark, text.cell("x"), " - ") == ""
    assert one(spark, text.spaceless("x"), "a b*-\n") == "AB*-"


def test_three_number_rules(spark):
    assert one(spark, text.digits_only("x"), "a12") is None
    assert one(spark, text.digits_only("x"), "12") == 12
    assert one(spark, text.first_number("x"), "a12b3") == 12
    assert one(spark, text.first_number("x", 10**9), "ab") == 10**9


def test_versions_and_dois(spark):
    assert one(spark, text.without_version("x"), "A.B") == "A.B"
    assert one(spark, text.accession_key("x"), "wp_1.2") == "WP_1"
    assert one(spark, text.dois("x"), "doi:10.1/A; https://dx.doi.org/10.2/b. 10.3/c, none") == ["10.1/a", "10.2/b", "10.3/c"]


def test_title_and_taxon(spark):
    row = one(spark, text.title_parts("x"), "MULTISPECIES: PETase; Flags: Precursor [Ideonella sp.]")
    assert (row.title, row.organism) == ("PETase", "Ideonella sp.")
    assert one(spark, text.taxon_id("x"), "123.0") == "123"
    assert one(spark, text.taxon_id("x"), "12a") == ""


@pytest.mark.parametrize(
    ("value", "expected"),
    [("WP_123456789.1", "refseq"), ("nm_12", "refseq_nucleotide"), ("ABC12345", "insd_protein"), ("5XFY_A", "pdb_chain"), ("7NEI", "pdb_entry"), ("MGYP1", "mgnify"), ("P19833", "uniprot"), ("AB123456", "insd_legacy"), ("-", "missing"), ("zzz!", "unrecognized")],
)
def test_accession_class(spark, value, expected):
    assert one(spark, accession.accession_class("x"), value) == expected


def test_order_of_identifiers(spark):
    assert one(spark, accession.order_problems("x"), "5XFY;WP_000000001.1") == ["out-of-order:WP_000000001.1", "primary-misplaced:WP_000000001.1"]
    assert one(spark, accession.order_problems("x"), "") == []
    assert one(spark, accession.order_problems("x"), "5XFY") == []
    assert one(spark, accession.reordered("x"), "5XFY; P19833 ;WP_000000001.1") == "WP_000000001.1;P19833;5XFY"


def test_families(spark):
    found = spark.createDataFrame([("PET hydrolase", "alpha/beta hydrolase"), ("lipase", "laccase"), ("x", "y")], "a string, b string")
    rows = found.select(families.agreement(families.families(F.col("a")), families.families(F.col("b"))).alias("y")).collect()
    assert [r.y for r in rows] == ["generic", "conflict", "unknown"]


def test_rank_match_consumes(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("", 3), ("z", 4)], "key string, a int")
    b = spark.createDataFrame([("k", 10), ("w", 11), ("", 12)], "key string, b int")
    got = {(r.key, r.a, r.b, r.source) for r in relate.rank_match(a, b, "key", ["a"], ["b"]).collect()}
    assert got == {("k", 1, 10, "both"), ("k", 2, None, "both"), ("z", 4, None, "left"), ("w", None, 11, "right"), ("", 3, None, "left"), ("", None, 12, "right")}


def test_lexical_and_numeric_sets(spark):
    df = spark.createDataFrame([("k", "9", "v9"), ("k", "10", "v10"), ("k", " ", None)], "k string, id string, v string")
    row = collapse.collapse(df, "k", ["id", "v"], ["v"]).first()
    assert (row.id, row.id_all, row.v, row.v_all, row.n_source_rows) == ("10", "10;9", "v9", "v9;v10", 3)


def test_filter_comes_after_the_best(spark):
    rows = spark.createDataFrame([("a", "b", 20.0, 1e-9, 100.0, 0), ("b", "a", 90.0, 1e-9, 50.0, 1)], "q string, t string, p double, e double, b double, o long")
    best = graph.best_pairs(rows, "q", "t", "p", "e", "b", "o")
    assert graph.edges(best).count() == 0
    assert graph.edges(graph.best_pairs(rows, "q", "t", "p", "e", "b", "o", "any")).count() == 1


def test_components_are_single_linkage(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "n long")
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (7, 7)], "a long, b long")
    got = {r.n: r.root for r in graph.partition(nodes, "n", links).collect()}
    assert got == {i: 0 if i <= 40 else 50 if i in (50, 51) else i for i in range(60)}


def test_upper_median(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    assert df.agg(collapse.upper_median("x").alias("m")).first().m == 3
    assert collapse.upper_median_of(df, "x").first().upper_median == 3


def test_greedy_kernels(spark):
    nodes = spark.createDataFrame([(1, 1, 5), (2, 2, 9), (3, 3, 7), (4, 4, 1)], "node long, ord long, len long")
    links = spark.createDataFrame([(1, 2, 0.95), (3, 2, 0.95), (2, 3, 0.95), (1, 3, 0.2)], "node long, other long, cover double")
    assert {(r.node, r.centroid) for r in cluster.greedy(nodes, links, "cover").collect()} == {(1, 2), (2, 2), (3, 2), (4, 4)}
    assert {(r.node, r.centroid) for r in cluster.greedy(nodes, links, "length").collect()} == {(1, 2), (2, 2), (3, 2), (4, 4)}


def test_seeds_come_first_and_nothing_is_lost(spark):
    nodes = spark.createDataFrame([(i, i, 5) for i in range(6)], "node long, ord long, len long")
    links = spark.createDataFrame([(0, 5, 0.95), (1, 2, 0.95), (2, 1, 0.95)], "node long, other long, cover double")
    seeds = spark.createDataFrame([(5, 0)], "node long, ord long")
    rows = cluster.seeded(nodes, links, seeds).collect()
    assert sorted(r.node for r in rows) == list(range(6))
    assert {r.cluster for r in rows if r.node in (0, 5)} == {1}
    for redundant in ("keep", "drop"):
        assert cluster.seeded(nodes, links, spark.createDataFrame([(1, 0), (2, 1)], "node long, ord long"), redundant=redundant).count() == 6


def test_labels_against_a_prior_partition(spark):
    m = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (3, "b"), (3, None), (4, "c"), (4, "d"), (5, None)], "c long, p string")
    got = {r.c: (r.kind, r.name) for r in graph.inherit_labels(m, "c", "p").collect()}
    assert got == {1: ("inherited", "a"), 2: ("split", "bb"), 3: ("split", "ba"), 4: ("merged", "Mc"), 5: ("novel", "N1")}


def test_containment_equals_brute_force(spark):
    texts = ["a b c d e", "x a b c d e y", "c d", "q c d e", "", None, "a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {(r.short_id, r.long_id) for r in relate.containment(df, df, "i", "t", "i", "t").collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if a and b and len(a) < len(b) and a in b}


def test_wildtype_collapse(spark):
    g = spark.createDataFrame([(1, "w", True), (1, "x", False), (2, "y", False), (3, "a", True), (3, "b", True)], "g long, n string, wt boolean")
    got = {r.n: (r.target, r.status) for r in variants.collapse_to_wildtype(g, "g", "n", "wt").collect()}
    assert got["x"] == ("w", "collapsed") and got["y"] == ("y", "no_wildtype") and got["a"] == ("a", "ambiguous")


def test_stale_edit_stops(spark):
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(Exception, match="stale edit"):
        rules.guarded_edits(rows, spark.createDataFrame([(1, "z", "b")], "k long, before string, after string"), "k", "v").collect()


def test_alignment():
    aligner = align.Aligner(align.default_scores())
    score, same, length, *_ = aligner.local("AAAWWWKKKDDD", "WWWKKKDDD")
    assert (same, length) == (9, 9) and score == 3 * 9 + 6 * 5
    score, same, length, *_ = aligner.local("WWWWWKKKKKKKKKK", "WWWWWGGKKKKKKKKKK")  # the gap of two wins
    assert (same, length) == (15, 17) and score == 5 * 9 + 10 * 5 - 13
    assert aligner.local("", "A")[0] == 0
    assert align.e_value(10, 100, 1000) == pytest.approx(2 * align.e_value(10, 100, 500))


def plain_scores(a, b, table, free):
    """Affine-gap scores by the plain program: the best local one, and the best from a common start to a common end."""
    low = -(10**9)
    m = [[0 if free or not i or not j else low for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    x, y = ([[low] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(2))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x[i][j] = max(m[i - 1][j] - 12, x[i - 1][j] - 1)
            y[i][j] = max(m[i][j - 1] - 12, y[i][j - 1] - 1)
            m[i][j] = max(m[i - 1][j - 1] + table[a[i - 1]][b[j - 1]], x[i][j], y[i][j], *([0] if free else []))
    return max(max(r) for r in m) if free else max(max(m[-1]), max(r[-1] for r in m))


def test_alignments_equal_a_plain_program():
    import random

    rng, table = random.Random(4), align.default_scores()
    aligner = align.Aligner(table)
    for _ in range(150):
        a = "".join(rng.choice("WKADP") for _ in range(rng.randrange(1, 14)))
        b = "".join(c for c in a if rng.random() < 0.8) + rng.choice(["", "KK", "WA"]) if rng.random() < 0.6 else "".join(rng.choice("WKADP") for _ in range(rng.randrange(1, 14)))
        if b:
            assert aligner.local(a, b)[0] == plain_scores(a, b, table, True)
            assert aligner.spanning(a, b)[0] == plain_scores(a, b, table, False)
    assert aligner.spanning("AAWWKKDD", "WWKKDD")[1:] == (6, 6, 6, 6)


@pytest.mark.parametrize("kind", ["cover", "length"])
def test_rounds_of_joins_cluster_like_the_kernel(spark, kind):
    import random

    rng = random.Random(6)
    nodes = spark.createDataFrame([(i, (i * 37) % 60, rng.randrange(5)) for i in range(60)], "node long, ord long, len long")
    links = spark.createDataFrame(list({(rng.randrange(60), rng.randrange(60)): 0 for _ in range(110)}), "node long, other long").selectExpr("node", "other", "0.85 + 0.01 * ((node * 7 + other * 3) % 15) as cover")
    one, many = (sorted(map(tuple, cluster.greedy(nodes, links, kind, 0.9, kernel_rows=n).select("node", "centroid").collect())) for n in (10**6, 1))
    assert one == many and len(one) == 60


def test_containment_equals_all_pairs(spark):
    import random

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bc", "the", "Öl", "x y", "", "stone"]) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    texts += [t[rng.randrange(3) : len(t) - rng.randrange(3)] for t in texts] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.short_id, r.long_id) for r in relate.containment(df, df, "id", "text", "id", "text").collect()}
    assert got == {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if s and t and len(s) < len(t) and s in t}


def test_ordered_lists(spark):
    rows = [(1, 3, "b; a"), (1, 1, "c;;b"), (1, 2, None), (2, 1, " "), (None, 1, "z;z"), (1, 1, "c;;b")]
    df = spark.createDataFrame(rows, "k long, o long, v string")
    got = {r.k: r.x for r in collapse.ordered_lists(df, "k", F.split("v", ";"), "o", "x").collect()}
    assert got == {1: ["c", "b", "a"], None: ["z"]}
    assert {r.k: r.x for r in collapse.ordered_lists(df, "k", F.col("v"), "o", "x").collect()} == {1: ["c;;b", "b; a"], None: ["z;z"]}


def test_a_common_beginning_makes_no_candidates(spark, monkeypatch):
    """Names with one prefix, and texts with one middle, meet only the texts that have their rare piece."""
    texts = [f"Customer#{i:09d}" for i in range(80)] + [f"x Customer#{i:09d} y" for i in range(80)]
    texts += [f"a terms of use apply to the site {i}{i} of b" for i in range(60)] + [f"c a terms of use apply to the site {i}{i} of b d" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    written = {}

    def kept(frame, name):
        written[name] = materialize(frame, name)
        return written[name]

    monkeypatch.setattr(relate, "materialize", kept)
    got = {(r.short_id, r.long_id) for r in relate.containment(df, df, "id", "text", "id", "text").collect()}
    assert got == {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if len(s) < len(t) and s in t}
    assert written["candidates"].count() <= 2 * len(got)


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("﻿id\tseq\tseq\textra\r\n1\tAA\tBB\tx\r\n\r\n2\tCC\r\n", encoding="utf-8")
    header, rows = delimited.scan(spark, str(path))
    assert header == ["id", "seq", "seq", "extra"]
    got = rows.orderBy("_row").select(delimited.nth(header, "id").alias("i"), delimited.nth(header, "seq", 2).alias("s")).collect()
    assert [(r.i, r.s) for r in got] == [("1", "BB"), ("2", "")]
    assert delimited.named(header, rows).columns == ["_row", "id", "seq", "extra"]
    with pytest.raises(ValueError, match="repeated"):
        delimited.named(header, rows, "refuse")
    with pytest.raises(ValueError, match="missing"):
        delimited.validated(delimited.named(header, rows), ["nope"])


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a x", "A" * 130), ("b|1", "CC"), ("c", "")], "h string, s string")
    sinks.write_fasta(df, str(tmp_path / "f"), F.col("h"), F.col("s"), ["h"])
    got = {r.header: r.sequence for r in records.fasta(spark, str(tmp_path / "f")).collect()}
    assert got == {"a x": "A" * 130, "b|1": "CC"}


def test_concatenated_json(spark):
    df = spark.createDataFrame([('{"a":1}{"b":2} [3]',), (None,), ("{",)], "t string")
    assert [r.json for r in records.concatenated_json(df, "t").orderBy("place").collect()] == ['{"a": 1}', '{"b": 2}', "[3]"]


def test_cluster_and_pair_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("q\tt\tid\tev\tbits\na\tb\t40.5\t1e-9\t50\nx\ty\n")
    assert [(r.query, r.pct_id) for r in delimited.pairs(spark, str(tmp_path / "p.tsv")).collect()] == [("a", 40.5)]
    (tmp_path / "c.uc").write_text("S\t0\t9\t*\t*\t*\t*\t*\tA\t*\nH\t0\t9\t98.5\t+\t*\t*\t*\tB\tA\nN\t*\n")
    seeds, hits = delimited.cluster_records(spark, str(tmp_path / "c.uc"))
    assert [r.label for r in seeds.collect()] == ["A"] and [(r.label, r.centroid, r.pct_id) for r in hits.collect()] == [("B", "A", 98.5)]


def test_steps(tmp_path):
    ran = []
    chain = [steps.Step("a", lambda: ran.append("a")), steps.Step("b", lambda: ran.append("b"), lambda: True), steps.Step("c", lambda: ran.append("c"))]
    assert [r["state"] for r in steps.run_steps(chain, last="b").rows] == ["done", "skipped", "out of range"]
    steps.run_steps(chain, first="b", force=True)
    assert ran == ["a", "b", "c"]
    assert steps.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(ValueError):
        steps.the_only([])


def test_evidence(spark):
    from seqloom.operators import evidence

    assert one(spark, evidence.live_protein(F.lit("AA"), F.col("x"), F.lit(None)), " ") is True
    assert one(spark, evidence.live_protein(F.lit("aa"), F.col("x"), F.lit("")), "dead") is False
    long = "ACDEFGHIKL" * 7
    known = F.array(F.lit(long), F.lit("SHORT"))
    assert one(spark, evidence.sequence_in(F.col("x"), known), long[3:]) is True
    assert one(spark, evidence.sequence_in(F.col("x"), known), "SHOR") is False
    assert one(spark, evidence.sequence_in(F.col("x"), known), "") is False
    assert one(spark, evidence.surnames(F.col("x")), ["Doe J", "doe K", " ", None, "Roe"], "array<string>") == ["doe", "roe"]
    files = spark.createDataFrame([("p", "supplement", ["A", "B"], None), ("p", "main", ["B"], ["S"]), ("q", "main", None, None)], "paper string, kind string, accessions array<string>, sequences array<string>")
    got = {r.paper: (r.accessions, r.sequences, r.status) for r in evidence.supplement_index(files, "paper").collect()}
    assert got == {"p": (["A", "B"], ["S"], "parsed"), "q": ([], [], "unavailable")}
    proteins = spark.createDataFrame([(1, "R1", "P1", "AA"), (2, "R1", "P9", "AA"), (3, "R1", "P9", "CC"), (4, "R2", "P1", "AA"), (5, None, "P1", "AA")], "k long, record string, protein_id string, sequence string")
    coding = spark.createDataFrame([("R1", "P1", "AA")], "record string, protein_id string, sequence string")
    assert {r.k: r.cds_match for r in evidence.coding_match(proteins, coding, "k").collect()} == {1: "by_id", 2: "by_sequence", 3: "mismatch", 4: "no_cds", 5: "unavailable"}
    pairs = spark.createDataFrame([("ABCDEFGHIJ", "xxABCDEFGHIJyy"), ("ABCDEFGHIJ", "QRSTUVW")], "a string, b string")
    assert [r.coverage for r in evidence.near_containment(pairs, "a", "b").collect()] == [1.0]
    tries = spark.createDataFrame([("d", "pdf", True), ("d", "epmc", True), ("d", "file", False)], "doi string, route string, ok boolean")
    assert evidence.best_attempt(tries, "doi", ["file", "epmc", "efetch", "pdf"]).first().route == "epmc"


def test_component_numbers(spark):
    m = spark.createDataFrame([(1, "PL0010", "x"), (1, "PL0002", "y"), (2, "PL0001", "z"), (3, "", "w"), (3, "", "v"), (3, "PL9", "u")], "root long, label string, node string")
    got = {r.root: (r.component_id, r.size, r.size_rank, r.canonical.node) for r in graph.number_components(m, "root", "label", "node").collect()}
    assert got == {2: ("C001", 1, 3, "z"), 1: ("C002", 2, 2, "y"), 3: ("C003", 3, 1, "u")}


def test_ranks_of_a_hot_key(spark):
    df = spark.createDataFrame([("k" if i % 3 else "z", 1000 - i) for i in range(600)], "key string, v int")
    got = relate.ranked(df, "key", ["v"]).collect()
    for key in "kz":
        ordered = sorted((r.v, r._rank) for r in got if r.key == key)
        assert [r for _, r in ordered] == list(range(1, len(ordered) + 1))


def test_cascade_takes_the_preferred_value(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    rows = spark.createDataFrame([(1, "AAA", "A"), (1, "MKVLA", "B"), (1, "MKVLC", "B"), (2, "", "A"), (2, "M", "B")], "k int, seq string, chain string")
    got = lambda prefer: {r.k: r.seq for r in relate.cascade(base, "k", [("x", rows)], "seq", prefer).collect()}
    assert got(None)[1] == "AAA"
    assert got(F.length("seq")) == {1: "MKVLA", 2: "M", 3: ""}
    assert got(F.struct(F.col("chain") == "A", F.length("seq"))) == {1: "AAA", 2: "M", 3: ""}


def test_all_pairs_misses_no_pair(spark):
    # two alike residues, then a different one: no common word of three
    rows = spark.createDataFrame([(1, "AWKAWRAWNAWD"), (2, "AWCAWQAWEAWG"), (3, "MMMMMMMMM")], "n int, seq string")
    assert align.shared_words(rows, "n", "seq", k=3, least=1).count() == 0
    assert sorted((r.a, r.b) for r in align.all_pairs(rows, "n").collect()) == [(1, 2), (1, 3), (2, 3)]
