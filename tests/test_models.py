"""Family models against plain programs: alignment, estimation, search-back, manifest."""

import collections
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import profiles
from seqloom.functions.align import default_scores
from seqloom.functions.profiles import RESIDUES, TRANSITIONS
from seqloom.operators import models
from seqloom.sources import records

SCORES = default_scores()
DATA = "/root/testdata/sf0.001"


def related(rng, n, length=14):
    base = "".join(rng.choice(RESIDUES) for _ in range(length))
    out = []
    for _ in range(n):
        s = list(base)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s))
            s[i : i + rng.randrange(2)] = rng.choice([[], [rng.choice(RESIDUES)], list("GG")])
        out.append("".join(s))
    return out


# --- alignment -------------------------------------------------------------------------------------------------------


def plain_join(a, b):
    """Two alignments (lists of rows) as one, cell by cell."""

    def shares(rows, j):
        c = collections.Counter(r[j] for r in rows)
        return {x: k / len(rows) for x, k in c.items() if x != "-"}

    n, m = len(a[0]), len(b[0])
    left, right = [shares(a, i) for i in range(n)], [shares(b, j) for j in range(m)]
    pair = [[round(100 * sum(p * q * SCORES[x][y] for x, p in u.items() for y, q in v.items())) for v in right] for u in left]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    gap = lambda k: 1100 + 100 * k
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + pair[i - 1][j - 1], *(best[k][j] - gap(i - k) for k in range(i)), *(best[i][k] - gap(j - k) for k in range(j)))
    end = max([(n, max(range(m + 1), key=lambda j: best[n][j])), (max(range(n + 1), key=lambda i: best[i][m]), m)], key=lambda e: best[e[0]][e[1]])
    (i, j), steps = end, []
    tail = [(k, None) for k in range(i, n)] + [(None, k) for k in range(j, m)]
    while i and j:
        if best[i][j] == best[i - 1][j - 1] + pair[i - 1][j - 1]:
            i, j = i - 1, j - 1
            steps.append((i, j))
            continue
        k = next((k for k in range(i - 1, -1, -1) if best[k][j] - gap(i - k) == best[i][j]), None)
        if k is not None:
            steps += [(x, None) for x in range(i - 1, k - 1, -1)]
            i = k
            continue
        k = next(k for k in range(j - 1, -1, -1) if best[i][k] - gap(j - k) == best[i][j])
        steps += [(None, x) for x in range(j - 1, k - 1, -1)]
        j = k
    columns = [(k, None) for k in range(i)] + [(None, k) for k in range(j)] + steps[::-1] + tail
    return ["".join("-" if x is None else r[x] for x, _ in columns) for r in a] + ["".join("-" if y is None else r[y] for _, y in columns) for r in b]


def plain_progressive(sequences):
    words = [{s[i : i + 3] for i in range(len(s) - 2)} for s in sequences]

    def apart(i, j):
        least = min(len(words[i]), len(words[j]))
        return 1 - len(words[i] & words[j]) / least if least else float(sequences[i] != sequences[j])

    groups = {i: ([s], [i]) for i, s in enumerate(sequences)}
    far = {(i, j): round(apart(i, j), 12) for i in groups for j in groups if i < j}
    new = len(sequences)
    while len(groups) > 1:
        i, j = min(((i, j) for i in groups for j in groups if i < j), key=lambda e: (far[e], e))
        a, b = groups.pop(i), groups.pop(j)
        for k in groups:
            x, y = far[min(i, k), max(i, k)], far[min(j, k), max(j, k)]
            far[k, new] = round((x * len(a[1]) + y * len(b[1])) / (len(a[1]) + len(b[1])), 12)
        groups[new] = (plain_join(a[0], b[0]), a[1] + b[1])
        new += 1
    ((rows, order),) = groups.values()
    return [r for _, r in sorted(zip(order, rows, strict=True))]


def sum_of_pairs(rows):
    return sum(SCORES[x][y] for a, b in itertools.combinations(rows, 2) for x, y in zip(a, b, strict=True) if "-" not in (x, y))


@pytest.mark.parametrize("seed", range(8))
def test_progressive_alignment(seed):
    rng = random.Random(seed)
    sequences = related(rng, rng.choice([1, 2, 3, 6])) + ["AC"] * (seed % 2)
    rows = profiles.progressive(sequences, SCORES)
    expected = plain_progressive(sequences)
    assert [r.replace("-", "") for r in rows] == sequences and len(set(map(len, rows))) == 1
    assert sum_of_pairs(rows) == sum_of_pairs(expected) and rows == expected


def test_placed_rows_keep_their_letters():
    rng = random.Random(3)
    for _ in range(40):
        first, *rest = related(rng, 5)
        rows = profiles.progressive([first, rest[0]], SCORES)
        for s in [*rest, "", "W", "G" * 40]:
            row = profiles.place(rows, s, SCORES)
            assert row.replace("-", "").upper() == s and sum(c.isupper() or c == "-" for c in row) == len(rows[0])


# --- estimation ------------------------------------------------------------------------------------------------------


def plain_estimate(rows, shares):
    """Emissions and transitions of one family from its rows, as the docstrings say."""
    columns = [[c for c in r if not c.islower()] for r in rows]
    width = len(columns[0])
    raw = []
    for c in columns:
        total = 0
        for j in range(width):
            seen = collections.Counter(x[j] for x in columns if x[j] != "-")
            if c[j] != "-":
                total += 1 / (len(seen) * seen[c[j]])
        raw.append(total)
    weight = [x / (sum(raw) / len(raw)) for x in raw]
    match = [j for j in range(width) if sum(w for c, w in zip(columns, weight, strict=True) if c[j] != "-") / sum(weight) >= 0.5 - 1e-9]
    emitted = [collections.Counter() for _ in match]
    moved = [collections.Counter() for _ in match]
    for row, w in zip(rows, weight, strict=True):
        column, before, pos = -1, None, 0
        for c in row:
            column += not c.islower()
            if not c.islower() and column in match:
                state, here = ("d" if c == "-" else "m"), match.index(column) + 1
                if c in RESIDUES:
                    emitted[here - 1][c] += w
            elif c != "-":
                state, here = "i", pos
            else:
                continue
            at = here - (state != "i")
            if before and 0 < at < len(match) and before + state in TRANSITIONS:
                moved[at - 1][before + state] += w
            before, pos = state, here
    emissions = [[(e[c] + 4 * shares[c]) / (sum(e.values()) + 4) for c in RESIDUES] for e in emitted]
    usual = dict(zip(TRANSITIONS, models.USUAL, strict=True))
    return emissions, [[(t[k] + 4 * usual[k]) / (sum(v for x, v in t.items() if x[0] == k[0]) + 4) for k in TRANSITIONS] for t in moved]


@pytest.fixture(scope="module")
def families(spark):
    rng = random.Random(11)
    rows = [(f, f"{f}{i}", s) for f, n in (("a", 30), ("b", 4), ("c", 1)) for i, s in enumerate(related(rng, n))]
    rows += [("a", "blank", ""), ("d", "null", None)]
    df = spark.createDataFrame(rows, "fam string, name string, seq string").withColumns({c: F.lit("x") for c in ("family", "member", "place", "row", "pos", "weight")})
    return df.select("fam", "name", "seq"), {(f, n): s for f, n, s in rows if s}


def test_estimate(spark, families, monkeypatch):
    """Also with members placed into an alignment of a few, dealt over several chunks."""
    monkeypatch.setattr(models, "CHUNK", 7)
    df, sequences = families
    shares = models.background(df, "seq")
    letters = collections.Counter("".join(sequences.values()))
    assert shares == {c: pytest.approx((letters[c] + 1) / (sum(letters[x] for x in RESIDUES) + 20)) for c in RESIDUES}
    for seeds in (60, 6):
        aligned = models.align_families(df, "fam", "name", "seq", seeds=seeds)
        rows = {(r.fam, r.name): r.row for r in aligned.collect()}
        assert {k: v.replace("-", "").upper() for k, v in rows.items()} == sequences
        found = collections.defaultdict(dict)
        for r in models.estimate(aligned, "fam", "name", shares).collect():
            found[r.fam][r.pos] = (r.emissions, r.transitions)
        assert set(found) == {"a", "b", "c"}
        for f, states in found.items():
            emissions, transitions = plain_estimate([v for k, v in sorted(rows.items()) if k[0] == f], shares)
            assert [states[p][0] for p in sorted(states)] == [pytest.approx(e) for e in emissions]
            assert [states[p][1] for p in sorted(states)] == [pytest.approx(t) for t in transitions]
            assert all(math.isclose(sum(e), 1) for e in emissions)


def test_profile_lines_read_back(spark, families, tmp_path):
    df, _ = families
    shares = models.background(df, "seq")
    built = models.estimate(models.align_families(df.where("fam = 'b'"), "fam", "name", "seq"), "fam", "name", shares)
    models.profile_lines(built, "fam").select("value").write.text(f"file://{tmp_path}/b.hmm")
    read = {(r.pos, r.residue): r.p for r in records.profile(spark, f"file://{tmp_path}/b.hmm").collect()}
    assert read == {(r.pos, r.residue): pytest.approx(r.p) for r in models.emission_rows(built, "fam").collect()}


def test_empty_table(spark):
    none = spark.createDataFrame([], "fam string, name string, seq string")
    shares = models.background(none, "seq")
    built = models.estimate(models.align_families(none, "fam", "name", "seq"), "fam", "name", shares)
    assert built.count() == 0 and models.search_back(built, none, "fam", "name", "seq", shares).count() == 0


# --- search-back -----------------------------------------------------------------------------------------------------


def every_path(odds, logs, codes):
    """(log score, first state, last state, first residue, last residue) of every local path."""
    length, step = len(odds), dict(zip(TRANSITIONS, range(7), strict=True))
    enter = -math.log(length * (length + 1) / 2)

    def go(state, k, i, score, first):
        if state == "m":
            yield score, first[0] + 1, k + 1, first[1] + 1, i
        if state in "mi" and i < len(codes) and k + 1 < length:
            yield from go("i", k, i + 1, score + logs[k][step[state + "i"]], first)
        if k + 1 < length:
            if i < len(codes):
                yield from go("m", k + 1, i + 1, score + logs[k][step[state + "m"]] + odds[k + 1][codes[i]], first)
            if state in "md":
                yield from go("d", k + 1, i, score + logs[k][step[state + "d"]], first)

    for k in range(length):
        for i in range(len(codes)):
            yield from go("m", k, i + 1, enter + odds[k][codes[i]], (k, i))


@pytest.mark.parametrize("seed", range(12))
def test_search_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(1, 5))
    odds, logs = profiles.log_model(rng.dirichlet(np.ones(20), length), np.concatenate([rng.dirichlet(np.ones(n), length) for n in (3, 2, 2)], axis=1), np.full(20, 0.05))
    names = ["".join(rng.choice(list(RESIDUES + "X"), int(rng.integers(1, 6)))) for _ in range(6)]
    found = profiles.search(odds, logs, names)
    for i, s in enumerate(names):
        paths = list(every_path(odds.tolist(), logs.tolist(), [RESIDUES.find(c) % 21 for c in s]))
        best = max(p[0] for p in paths)
        assert found["score"][i] == pytest.approx(best / math.log(2))
        assert found["forward"][i] == pytest.approx(math.log(sum(math.exp(p[0]) for p in paths)) / math.log(2))
        assert tuple(found[c][i] for c in ("hmm_from", "hmm_to", "seq_from", "seq_to")) in {p[1:] for p in paths if math.isclose(p[0], best, abs_tol=1e-9)}


def test_manifest(spark, families, monkeypatch):
    monkeypatch.setattr(models, "CHUNK", 7)
    df, sequences = families
    shares = models.background(df, "seq")
    built = models.estimate(models.align_families(df, "fam", "name", "seq"), "fam", "name", shares)
    hits = models.search_back(built, df, "fam", "name", "seq", shares).collect()
    assert {(h.fam, h.name) for h in hits} == set(sequences) and all(h.forward >= h.score for h in hits)
    sizes = df.groupBy("fam").agg(F.count("*").alias("n_members"))
    got = {r.fam: r for r in models.manifest(spark.createDataFrame(hits), sizes, "fam", least=20.0, floor=0.9).collect()}
    for f, n in (("a", 31), ("b", 4), ("c", 1), ("d", 1)):
        own = [(h.seq_to - h.seq_from + 1) / h.target_length for h in hits if h.fam == f and h.score >= 20]
        flags = [f"undetected={n - len(own)}"] * (len(own) < n) + ["low_member_coverage"] * (sum(own) / max(len(own), 1) < 0.9) + ["singleton_model"] * (n == 1)
        assert (got[f].n_members, got[f].n_detected, got[f].flags) == (n, len(own), ";".join(flags))
        assert got[f].mean_member_coverage == pytest.approx(round(sum(own) / max(len(own), 1), 4), abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_queries_on_the_parts(spark):
    """The registered queries: rows add up to the members, each family has one profile, search-back agrees with one sequence at a time."""
    from seqloom import queries_models as q

    members = {(r.family, r.member): r.sequence for r in q._members(spark, DATA).collect()}
    n = collections.Counter(f for f, _ in members)
    columns = collections.Counter()
    for r in q.family_alignment(spark, DATA).collect():
        columns[r.family, r.column] += r.n
    assert columns and all(k == n[f] for (f, _), k in columns.items())
    p = collections.defaultdict(dict)
    for r in q.family_profiles(spark, DATA).collect():
        p[r.family, r.pos][r.residue] = r.p
    assert {f for f, _ in p} == set(n) and all(abs(sum(v.values()) - 1) < 1e-6 for v in p.values())
    hits = {(r.family, r.member): r for r in q.family_search(spark, DATA).collect()}
    assert set(hits) == set(members)
    built, shares = q._models(q._members(spark, DATA))
    states = collections.defaultdict(dict)
    for r in built.collect():
        states[r.family][r.pos] = (r.emissions, r.transitions)
    base = np.array([shares[c] for c in RESIDUES])
    for (f, m), s in itertools.islice(sorted(members.items()), 0, None, 17):
        model = [states[f][k] for k in sorted(states[f])]
        alone = profiles.search(*profiles.log_model(np.array([e for e, _ in model]), np.array([t for _, t in model]), base), [s])
        assert hits[f, m].score == pytest.approx(alone["score"][0], abs=1e-5)
    got = {r.family: r for r in q.family_manifest(spark, DATA).collect()}
    for f in n:
        own = [(h.seq_to - h.seq_from + 1) / h.target_length for h in hits.values() if h.family == f and h.score >= 0]
        model = [(h.hmm_to - h.hmm_from + 1) / h.query_length for h in hits.values() if h.family == f]
        assert got[f].n_members == n[f] and got[f].n_detected == len(own)
        assert got[f].mean_member_coverage == pytest.approx(sum(own) / max(len(own), 1), abs=1e-4) and got[f].min_hmm_coverage == pytest.approx(min(model), abs=1e-4)
