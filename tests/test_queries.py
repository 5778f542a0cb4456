"""Each library query against its DuckDB counterpart on the smallest tables."""

import math
import os

import duckdb
import pytest

from seqloom import queries, queries_files, queries_growth, queries_models, queries_records  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = duck.sql(queries.ORACLE[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


# --- queries that SQL cannot express, against plain programs ---------------------------------------------------------


#: Tested in test_models.py, test_seeds.py and test_growth.py.
FAMILIES = {"family_alignment", "family_profiles", "family_search", "family_manifest", "remote_alignment", "near_contained_parts", "forward_clusters"}


def test_every_query_has_a_counterpart():
    assert set(queries.QUERIES) - set(queries.ORACLE) == {"fuzzy_ratio", "near_contained", "local_alignment", "near_global", "seeded_clusters", "cluster_levels", *FAMILIES}


def rows_of(duck, sql):
    return duck.sql(sql).fetchall()


def test_fuzzy_ratio(spark, duck):
    import difflib

    expected = {}
    for key, a, b in rows_of(duck, "select p_partkey, p_name, p_type from part"):
        ratio = difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        expected[key] = (pytest.approx(ratio), pytest.approx(sum(m.size for m in blocks) / len(b)))
    assert {r.p_partkey: (r.ratio, r.coverage) for r in queries.QUERIES["fuzzy_ratio"](spark, DATA).collect()} == expected


def test_near_contained(spark, duck):
    got = {r.p_partkey: r.coverage for r in queries.QUERIES["near_contained"](spark, DATA).collect()}
    assert got == {key: 1.0 for (key,) in rows_of(duck, "select p_partkey from part")}


def plain_local(a, b, table):
    """The best local score with affine gaps, by the plain program."""
    low, best = -(10**9), 0
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    x, y = ([[low] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(2))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x[i][j] = max(m[i - 1][j] - 12, x[i - 1][j] - 1)
            y[i][j] = max(m[i][j - 1] - 12, y[i][j - 1] - 1)
            m[i][j] = max(0, m[i - 1][j - 1] + table[a[i - 1]].get(b[j - 1], -4), x[i][j], y[i][j])
            best = max(best, m[i][j])
    return best


def test_local_alignment(spark, duck):
    import re

    from seqloom.functions import align

    names = {k: re.sub("[^A-Z]", "", n.upper()) for k, n in rows_of(duck, "select n_nationkey, n_name from nation")}
    scores = align.default_scores()
    table = {a: {b: scores.get(a, {}).get(b, -4) for b in map(chr, range(65, 91))} for a in map(chr, range(65, 91))}
    words = {k: set(n) for k, n in names.items()}
    expected = {(a, b): round(align.bit_score(plain_local(names[a], names[b], table)), 6) for a in names for b in names if a < b and len(words[a] & words[b]) >= 2}
    assert {(r.a, r.b): round(r.bits, 6) for r in queries.QUERIES["local_alignment"](spark, DATA).collect()} == expected and expected


def test_near_global(spark, duck):
    """Every name has the same letters with 0 to 3 repeats behind them, an end gap: all are identical where they overlap."""
    keys = sorted(k for (k,) in rows_of(duck, "select n_nationkey from nation"))
    got = {r.b: (r.a, r.pct_id) for r in queries.QUERIES["near_global"](spark, DATA).collect()}
    assert got == {k: (keys[0], 100.0) for k in keys[1:]}


def plain_greedy(nodes, links, cover):
    """The node that covers most uncovered nodes comes next, ties by number."""
    near = {n: {a for a, b, c in links if b == n and c >= cover and a != n and a in nodes} for n in nodes}
    centroid = {}
    while len(centroid) < len(nodes):
        n = max((x for x in nodes if x not in centroid), key=lambda x: (sum(m not in centroid for m in near[x]), -x))
        centroid[n] = n
        for m in near[n]:
            centroid.setdefault(m, n)
    return centroid


LINKS = "select l_partkey, l_suppkey, max(round(l_discount * 10, 3)) from lineitem where l_partkey <> l_suppkey group by 1, 2"


def test_cluster_levels(spark, duck):
    nodes, links = {k for (k,) in rows_of(duck, "select p_partkey from part")}, rows_of(duck, LINKS)
    at, expected = {n: n for n in nodes}, {}
    for level, cover in enumerate((0.9, 0.6, 0.3)):
        heads = set(at.values())
        found = plain_greedy(heads, [x for x in links if x[0] in heads and x[1] in heads], cover)
        at = {n: found[c] for n, c in at.items()}
        expected |= {(n, level): c for n, c in at.items()}
    assert {(r.node, r.level): r.centroid for r in queries.QUERIES["cluster_levels"](spark, DATA).collect()} == expected


def test_seeded_clusters(spark, duck):
    nodes, links = {k for (k,) in rows_of(duck, "select p_partkey from part")}, rows_of(duck, LINKS)
    seeds = {k for (k,) in rows_of(duck, "select s_suppkey from supplier where s_suppkey % 5 = 0")} & nodes
    centroid = {s: s for s in seeds}
    for n in sorted(nodes - seeds):
        options = [(-c, b) for a, b, c in links if a == n and b in seeds and c >= 0.9]
        if options:
            centroid[n] = min(options)[1]
    rest = nodes - set(centroid)
    centroid |= plain_greedy(rest, [x for x in links if x[0] in rest and x[1] in rest], 0.9)
    numbers = {c: i for i, c in enumerate([*sorted(seeds), *sorted(n for n in rest if centroid[n] == n)], 1)}
    got = {r.node: (r.cluster, r.role) for r in queries.QUERIES["seeded_clusters"](spark, DATA).collect()}
    assert got == {n: (numbers[c], "centroid" if c == n else "member") for n, c in centroid.items()}
