"""Spelling variants, SimHash links and periodic runs against plain programs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import periodic_runs, simhash, spelling
from seqloom.llm.periodic_runs import find_periodic_runs
from seqloom.llm.simhash import simhash_components
from seqloom.llm.spelling import spelling_variants

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def frame(spark, rows, schema="doc_id long, text string"):
    """With extra columns that clash with the operators' own names."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("x") for c in ("id", "word", "run", "n", "key", "rest", "fp", "root", "node", "name", "runs", "start") if c not in df.columns})


# --- 11 --------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    count = collections.Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w, ""), words.get(form.get(w), 0), root(w)) for w, n in words.items())


def got_variants(spark, rows):
    out = spelling_variants(frame(spark, rows)).collect()
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in out)


@pytest.mark.parametrize("group", [400, 3])
def test_spelling_variants(spark, monkeypatch, group):
    """Also where nearly every segment is shared by too many words, so that rests are cut down to one character."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(5)
    base = ["".join(rng.choice("abé×") for _ in range(rng.randrange(5, 11))) for _ in range(25)] + ["naaaaaation", "aaaaa", "aaaaaa", "Straße", "ÀlaÀla"]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 6, 12, 40])
        for _ in range(6):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :]])] * rng.choice([1, 3, 5])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)] + [(None, "Words words words"), (7, None), (8, ""), (8, " 12 ."), (9, "longword " * 20_000), (9, "longwort " * 9)]
    assert got_variants(spark, rows) == plain_variants(rows)


def test_spelling_chain_and_empty_table(spark):
    rows = [(1, " ".join(f"{w} " * n for w, n in (("axxxx", 48), ("abxxx", 24), ("abcxx", 12), ("abcdx", 6), ("abcde", 3), ("zbcde", 3))))]
    rows = [r for k in range(200) for r in [(k, rows[0][1])] if not any(zlib.crc32(f"{k}:{w}".encode()) % 97 == 0 for w in rows[0][1].split())][:1]
    assert {x[0]: x[5] for x in got_variants(spark, rows)} == dict.fromkeys(("axxxx", "abxxx", "abcxx", "abcdx", "abcde"), "axxxx") | {"zbcde": "zbcde"}
    assert spelling_variants(frame(spark, [])).count() == 0


# --- 12 --------------------------------------------------------------------------------------------------------------


def plain_print(text):
    words = (text or "").encode().translate(BYTES).split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(prints):
    """For each fingerprint the least of those that links reach."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(root)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in known}


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    root = joined(prints)
    least = {}
    for (k, _), p in zip(rows, prints, strict=True):
        if k is not None:
            least[root[p]] = min(k, least.get(root[p], k))
    return sorted((-1 if k is None else k, f"{p:016x}", least.get(root[p], -1)) for (k, _), p in zip(rows, prints, strict=True))


def test_simhash_components(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["tree", "río", "Stone", "sky"]) + str(rng.randrange(90)) for _ in range(rng.choice([1, 2, 3, 9, 60, 400]))) for _ in range(30)]
    rows = list(enumerate(base))
    for i in range(60):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(900, base[5].upper()), (5, base[5]), (901, None), (902, ""), (903, " \n\t"), (904, "one"), (905, "One two"), (None, "nobody else has this"), (906, "a b c " * 30_000)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in simhash_components(frame(spark, rows)).collect())
    assert got == plain_components(rows)
    assert len({x[2] for x in got}) < len({x[1] for x in got})  # unequal fingerprints link
    assert simhash_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("group", [256, 4])
def test_simhash_misses_no_link(spark, monkeypatch, group):
    """Groups of near copies around a few fingerprints, so that values are shared by many and are cut again."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(3)] + [0, (1 << 64) - 1]
    prints = {rng.getrandbits(64) for _ in range(200)} | set(centres)
    for _ in range(700):
        weak = [1 << b for b in (3, 4, 9, 17, 22, 31, 40, 41, 55, 63)]
        x = rng.choice(centres)
        for f in rng.sample(weak, rng.randrange(1, 6)):
            x ^= f
        prints.add(x ^ (1 << rng.randrange(64) if rng.random() < 0.3 else 0))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = {(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_fingerprints(spark.createDataFrame(signed, "fp long")).collect()}
    known = sorted(signed)
    expected = {(a % (1 << 64), b % (1 << 64)) for i, (a,) in enumerate(known) for (b,) in known[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert links == expected and len(expected) > 2000


def test_thresholds_add_up_and_avoid_crowded_parts():
    tables = [[np.ones(1 << 16)] for _ in range(4)]
    tables[2][0][:] = 10_000
    plan = simhash.Plan([list(range(i, i + 16)) for i in range(0, 64, 16)], tables, 1 << 16)
    t = plan.thresholds(np.arange(5, dtype=np.int64))
    assert (t.sum(axis=1) == 2 - 4 + 1).all() and (t[:, 2] == -1).all()


# --- 13 --------------------------------------------------------------------------------------------------------------


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + n - d)) for d in range(1, q) if q % d == 0):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(k, text, plant):
    w = (text or "").encode().split()
    h = zlib.crc32(str("" if k is None else k).encode())
    if plant and h % 10 == 0 and w:
        a, n = h // 10 % len(w), len(w)
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (-1 if k is None else k, len(w), len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(said).hexdigest(), hashlib.sha256(kept).hexdigest())


def repetitive(rng):
    w = [rng.choice("abcdefg"[: rng.choice([1, 2, 3, 7])]) for _ in range(rng.randrange(120))]
    for _ in range(rng.randrange(3)):
        if w:
            p, s = rng.randrange(1, max(2, len(w) // 4 + 1)), rng.randrange(len(w))
            for i in range(s + p, min(len(w), s + p * rng.randrange(2, 9))):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_runs(spark, plant):
    rng = random.Random(6)
    rows = [(i, " \n".join(repetitive(rng))) for i in range(400)] + [(None, "x y " * 9), (3, "x y " * 9), (3, "x y " * 9), (4, None), (5, ""), (6, " \t"), (7, "a " * 5), (8, "a " * 6), (9, "A a " * 4), (10, "é è " * 7)]
    got = find_periodic_runs(frame(spark, rows), plant=plant).collect()
    key = lambda r: (r[0], r[-1])
    assert sorted(((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got), key=key) == sorted((plain_row(k, t, plant) for k, t in rows), key=key)
    assert find_periodic_runs(frame(spark, [])).count() == 0


def test_periodic_runs_in_long_texts(spark):
    """Runs of runs, and texts of one word: the work stays near the length."""
    rows = [(1, ("a " * 3000 + "b ") * 9), (2, "a " * 200_000), (3, " ".join(str(i % 7000) for i in range(60_000)))]
    got = {r.doc_id: r for r in find_periodic_runs(frame(spark, rows), details=True).collect()}
    assert [tuple(x) for x in got[1].runs] == [(i * 3001, 3000, 1) for i in range(1)] + [(0, 27009, 3001)] + [(i * 3001, 3000, 1) for i in range(1, 9)]
    assert got[1].collapsed == "a b" and got[2].collapsed == "a" and (got[3].start, got[3].length, got[3].period) == (0, 60_000, 7000)


def test_periodic_runs_with_equal_hashes(monkeypatch):
    """Unequal words whose prefix hashes agree: the words themselves decide."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x & np.uint64(0))
    for seed in range(60):
        w = repetitive(random.Random(seed))
        assert periodic_runs.periodic_runs(periodic_runs.numbered([x.encode() for x in w])) == plain_runs(w)
