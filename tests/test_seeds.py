"""Candidates for alignment and near containment: recall and results against all pairs."""

import difflib
import os
import random

import pytest

from seqloom.functions.align import Aligner, default_scores
from seqloom.functions.profiles import RESIDUES
from seqloom.operators import seeds

DATA = "/root/testdata/sf0.001"
ALIKE = {c: g for g in ("ILMV", "FWY", "KRH", "DE", "NQ", "ST", "AG", "C", "P") for c in g}


def remote(rng, base, identity):
    """A copy in which so many residues stay, a third of the others change to like ones, with two short gaps."""
    out = [c if rng.random() < identity else rng.choice(ALIKE[c]) if rng.random() < 1 / 3 else rng.choice(RESIDUES) for c in base]
    for _ in range(2):
        i = rng.randrange(len(out))
        out[i:i] = rng.choices(RESIDUES, k=rng.randrange(4))
    return "".join(out)


@pytest.mark.parametrize("salted", [False, True])
def test_recall_of_remote_pairs(spark, monkeypatch, salted):
    """Families at 30 to 40 % identity among unrelated sequences: at least 0.9 of the related pairs, few others."""
    if salted:
        monkeypatch.setattr(seeds, "FREQUENT", 3)
    rng = random.Random(3)
    rows, family = [], {}
    for f in range(6):
        base = "".join(rng.choices(RESIDUES, k=260))
        for i in range(5):
            family[len(rows)] = f
            rows.append((len(rows), remote(rng, base, 0.48)))  # two copies: somewhat over 0.48 * 0.48 of the residues agree
    for _ in range(20):
        family[len(rows)] = None
        rows.append((len(rows), "".join(rng.choices(RESIDUES, k=260))))
    rows += [(900, ""), (901, "ACD"), (902, None)]
    aligner = Aligner(default_scores())
    related = {(a, b) for a in family for b in family if a < b and family[a] is not None and family[a] == family[b]}
    shares = [100 * same / length for a, b in related for _, same, length, *_ in [aligner.local(rows[a][1], rows[b][1])]]
    print("identity", sum(shares) / len(shares))
    assert 30 <= sum(shares) / len(shares) <= 42
    got = {(r.a, r.b) for r in seeds.seeded_pairs(spark.createDataFrame(rows, "node long, sequence string"), "node", "sequence").collect()}
    assert len(got & related) >= 0.9 * len(related)
    assert len(got - related) <= 0.3 * len(family) ** 2 / 2
    if not salted:
        print("recall", len(got & related) / len(related), "others", len(got - related))


def test_extension_score(spark):
    """The reach of a pair is its best ungapped stretch through the first common word."""
    got = seeds.seeded_pairs(spark.createDataFrame([(1, "WWWWWACDEFGHIKPPPPP"), (2, "GGACDEFGHIKNNNNN")], "node long, sequence string"), "node", "sequence", least=0).collect()
    score = default_scores()
    assert [(r.a, r.b, r.reach) for r in got] == [(1, 2, sum(score[c][c] for c in "ACDEFGHIK"))]


def plain_near(rows, cover, gaps):
    out = {}
    for i, x in rows:
        for j, y in rows:
            if i != j and x and y and (len(y) > len(x) or len(y) == len(x) and i < j) and seeds.window(len(x), cover, gaps):
                blocks = [m.size for m in difflib.SequenceMatcher(None, y, x, autojunk=False).get_matching_blocks() if m.size]
                if len(blocks) <= gaps + 1 and sum(blocks) >= cover * len(x) - 1e-9:
                    out[i, j] = pytest.approx(sum(blocks) / len(x))
    return out


@pytest.mark.parametrize("gaps", [0, 2])
def test_near_containment(spark, gaps):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        s = "".join(rng.choices(RESIDUES + "é漢", k=rng.randrange(5, 90)))
        rows.append(s)
        for _ in range(3):
            t = list(s[rng.randrange(3) :])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choices(RESIDUES, k=rng.randrange(3))
            rows.append("".join(rng.choices(RESIDUES, k=rng.randrange(30))) + "".join(t) + "".join(rng.choices(RESIDUES, k=rng.randrange(30))))
    rows = list(enumerate([*rows, rows[0], "", None, "ab", "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]))
    got = {(r.short, r.long): r.coverage for r in seeds.near_contained_pairs(spark.createDataFrame(rows, "node long, text string"), "node", "text", gaps=gaps).collect()}
    expected = plain_near(rows, 0.92, gaps)
    assert got == expected and len(expected) > 25
    assert seeds.near_contained_pairs(spark.createDataFrame([], "node long, text string"), "node", "text").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_queries_on_the_tables(spark):
    from seqloom import queries_models as q

    nodes = {r.node: r.sequence for r in q._nodes(spark, DATA).collect()}
    aligner, scores = Aligner(default_scores()), {}
    for a in nodes:
        for b in nodes:
            if a < b:
                scores[a, b] = aligner.local(nodes[a], nodes[b])[0]
    got = {(r.a, r.b): r.score for r in q.remote_alignment(spark, DATA).collect()}
    assert got == {k: scores[k] for k in got}
    strong = {k for k, v in scores.items() if v >= 40}
    assert len(strong & set(got)) >= 0.9 * len(strong) > 0
    found = {(r.short, r.long): r.coverage for r in q.near_contained_parts(spark, DATA).collect()}
    assert found == plain_near(sorted(nodes.items()), 0.92, 2) and found
