"""The training-data operators against brute force, with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import html
import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import blocks, bpe, decontaminate, html_extract, jaccard_join, partenum, quality_rules, toxicity, url_filter
from seqloom.llm.blocks import decode, encode
from seqloom.llm.chat_format import format_chats
from seqloom.llm.jaccard_join import jaccard_components
from seqloom.llm.line_dedup import line_dedup
from seqloom.llm.substring_dedup import substring_dedup

WORDS = "the of and bird stone river cloud green über naïve 漢字 x1 run-time".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, shorts, blanks and nulls."""
    rng = random.Random(7)
    base = [prose(rng, rng.choice([3, 6, 20, 60, 200, 400])) for _ in range(60)]
    passage = prose(rng, 60)
    texts = list(base)
    for i in range(40):
        words = rng.choice(base).split()
        for _ in range(max(1, len(words) // rng.choice([15, 40, 100]))):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [prose(rng, 20) + " " + passage + "\t" + prose(rng, rng.randrange(60)) for _ in range(12)]
    texts += [base[3], base[3].upper(), base[4], passage + " " + passage, "", "  \n ", None, "one", "One", "a b", prose(rng, 30_000)]
    return list(enumerate(texts)) + [(5, base[5])]


def frame(spark, rows, schema="doc_id long, text string"):
    """With extra columns that clash with the operators' own names."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("x") for c in ("id", "node", "root", "block", "payload", "n_words", "score", "kept") if c not in df.columns})


def ascii_words(text):
    return (text or "").encode().split()


def test_key_codec():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (decode(encode(keys)) == keys).all()
    assert len(decode(encode(keys[:0]))) == 0


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_substring_dedup(spark, corpus):
    # with 9 bits of the first hash nearly all windows seem to repeat; the second tells them apart
    got, weak = (sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, corpus), width=35, key_bits=b).collect()) for b in (64, 9))
    assert got == weak
    count = collections.Counter(b" ".join(w[i : i + 35]) for _, t in corpus for w in [ascii_words(t)] for i in range(len(w) - 34))
    expected = []
    for k, t in corpus:
        w = ascii_words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[b" ".join(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        expected.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert got == sorted(expected)
    assert any(x[2] for x in expected)


def test_substring_intervals_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = substring_dedup(frame(spark, [(1, "a b " + text), (2, text + " c"), (None, None)]), keep_text=True).collect()
    by = {r.doc_id: r for r in rows}
    assert [(s["first"], s["end"]) for s in by[1].intervals] == [(2, 52)] and by[1].kept_text == "a b" and by[2].kept_text == "c"
    assert substring_dedup(frame(spark, [])).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_components(rows):
    table = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(table).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = components(links, range(len(rows)))
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(rows[i][0], least.get(r, rows[i][0]))
    return sorted((rows[i][0] if rows[i][0] is not None else -1, len(sets[i]), (least.get(r) if sets[i] else rows[i][0]) or 0) for i, r in root.items())


def test_jaccard_components(spark, corpus):
    rows = [*corpus, (None, "nobody has these words but this one row here"), (None, None)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id or 0) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)
    assert jaccard_components(frame(spark, [])).count() == 0


def test_jaccard_threshold_is_met_exactly(spark):
    """Sets of equal size that share exactly 80 % or one feature less of their union."""
    base = [f"t{i}" for i in range(94)]  # 90 shingles; replacing the last k words changes k shingles
    rows = [(0, " ".join(base)), (1, " ".join([*base[:84], *(f"u{i}" for i in range(10))])), (2, " ".join([*base[:83], *(f"v{i}" for i in range(11))]))]
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2}  # 80 of 100 links, 79 of 101 does not


def test_partenum_misses_no_pair():
    rng = np.random.default_rng(3)
    for size in (4, 5, 8, 9, 17, 40, 90, 300, 700):
        for trial in range(12):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            drop = int(len(a) * rng.uniform(0, 0.11)) if trial % 2 else len(a) // 5
            b = a[drop:] if trial % 4 == 0 else np.unique(np.concatenate([a[drop // 2 :], rng.integers(0, 2**64, drop // 2, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < 80 * (len(a) + len(b) - common):
                continue
            signed = partenum.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            # whatever the counts are, equal keys having equal ones, the prefixes still meet
            for counts in (np.ones(len(signed.keys)), signed.keys % np.uint64(5), 9 - (signed.keys % np.uint64(2)).astype(int)):
                keep = signed.needed(counts)
                keys, sets = signed.keys[keep], signed.sets[keep]
                assert set(keys[sets == 0]) & set(keys[sets == 1]), (size, trial)


def test_prefixes_leave_out_a_hot_passage():
    """Sets that share a large part with very many strangers keep few of its signatures."""
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**64, 60, dtype=np.uint64)])) for _ in range(200)]
    signed = partenum.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    _, place, times = np.unique(signed.keys, return_inverse=True, return_counts=True)
    before, after = times[place] > 1, (times[place] > 1) & signed.needed(times[place])
    assert after.sum() < 0.4 * before.sum()


def test_jaccard_many_near_copies_and_a_common_passage(spark):
    rng = random.Random(5)
    base, passage = prose(rng, 120).split(), prose(rng, 50)
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(len(w))] = f"q{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, passage + " " + prose(rng, 25)) for i in range(120)]
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(150)) and all(got[1000 + i] == 1000 + i for i in range(120))


def test_jaccard_copies_without_their_original(spark):
    """Copies with several changes each: few link with the centre, so partners meet by their rare features."""
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = prose(rng, 120).split()
        for i in range(70):
            w = list(base)
            for at in rng.sample(range(0, 120, 10), 2):
                w[at + rng.randrange(2)] = f"q{rng.randrange(40)}"
            rows.append((100 * g + i, " ".join(w)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("own", [120, 50])
def test_jaccard_pages_of_one_template(spark, monkeypatch, own):
    """Pages that share 280 shingles without linking (0.54 and 0.74): no written table grows faster than the pages, and a true link is found."""
    common, rows_of, materialize = " ".join(f"c{i}" for i in range(284)), {}, jaccard_join.materialize

    def counted(df, name):
        out = materialize(df, name)
        rows_of[size, name] = rows_of.get((size, name), 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    for size in (300, 1200):
        rows = [(i, common + " " + " ".join(f"o{i}x{j}" for j in range(own))) for i in range(size)]
        rows.append((size, rows[7][1].replace("o7x3", "other")))
        got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows)).collect()}
        assert got == {i: i for i in range(size)} | {size: 7}
    assert {name: (n, rows_of[1600, name]) for (s, name), n in rows_of.items() if s == 300 and rows_of[1200, name] > 5 * n + 3000} == {}


def test_rare_features_miss_no_link():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(100):
        base = rng.integers(0, 2**63, int(rng.choice([1, 3, 5, 9, 20, 60, 200, 500])), dtype=np.uint64)
        for _ in range(5):
            more = rng.integers(0, 2**63, int(len(base) * rng.choice([0, 0.03, 0.12, 0.2])), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) >= rng.choice([0, 0.04, 0.1, 0.18])], more])))
    sets = [s for s in sets if len(s)]
    feature, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    _, place, times = np.unique(feature, return_inverse=True, return_counts=True)
    by_key = collections.defaultdict(list)
    for key, *entry in zip(*(x.tolist() for x in jaccard_join.rare_features(feature, offsets, times[place])), strict=True):
        by_key[key].append(entry)
    met = set()
    for group in by_key.values():
        for (x, p, s), (y, q, t) in itertools.combinations(group, 2):
            if (s == t == -1 or s + t == 1) and 180 * min(len(sets[x]) - p, len(sets[y]) - q) >= 80 * (len(sets[x]) + len(sets[y])):
                met.add((min(x, y), max(x, y)))
    whole = [set(s.tolist()) for s in sets]
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(whole[i] & whole[j]) >= 80 * len(whole[i] | whole[j])}
    assert links <= met and len(links) > 300


def test_block_sizes_follow_the_input():
    """Keys in one bucket's task and in one row, for the Jaccard join (0.13 keys a byte)."""
    table = {}
    for gb in (0.1, 30, 1000, 100_000):
        size = blocks.block_size(int(gb * 1e9))
        n = blocks.bucket_count(gb * 1e9 * 0.13, max(1, int(gb * 1e9 / size)), max(8, int(min(gb * 8, 20_000))))
        table[gb] = (gb * 1e9 * 0.13 / n, size * 0.13 / n)
    assert table[30][0] < 1.1e6 and table[1000][0] < 1.6e7 and table[100_000][0] < 2e8
    assert all(row >= 15 for _, row in table.values())


def test_results_do_not_depend_on_blocks(spark, corpus, monkeypatch):
    expected = sorted(map(tuple, substring_dedup(frame(spark, corpus)).select("doc_id", "n_removed", "kept_sha256").collect())), brute_components(corpus)
    monkeypatch.setattr(blocks, "BUCKET_KEYS", 50)
    monkeypatch.setattr(blocks, "ROW_KEYS", 4)
    got = sorted(map(tuple, substring_dedup(frame(spark, corpus), block_bytes=2000).select("doc_id", "n_removed", "kept_sha256").collect()))
    assert got == expected[0]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, corpus), block_bytes=2000).collect()) == expected[1]


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_base_counts():
    texts = ["a b c d e\na b c d e", None, "", "*** ### x\n \n*** ### x\n", "é漢 é漢 é漢 é漢 é漢 é漢", "p q\np q\np q"]
    got = quality_rules.base_counts(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                again += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        assert (got["n_words"][i], got["word_chars"][i], got["n_symbols"][i], got["n_dup_lines"][i], got["n_repeat_words"][i]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover))


@pytest.mark.parametrize(("errors", "n", "risk"), [(0, 100, 0.05), (3, 50, 0.01), (10, 1000, 0.001)])
def test_exact_binomial_bound(errors, n, risk):
    p = quality_rules.upper_bound(errors, n, risk)
    tail = lambda q: sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(errors + 1))
    assert tail(p + 1e-6) < risk <= tail(p - 1e-6)
    assert quality_rules.upper_bound(n, n, risk) == 1.0


def test_quality_rules_keep_and_reject(spark):
    rng = random.Random(2)
    clean = [(i, prose(rng, 30), "en") for i in range(900)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 30).split()), "en") for i in range(60)]
    other = [(2000, prose(rng, 30) + " ##########", None), (None, None, "en"), (2001, "", None), (2000, prose(rng, 30), None)]
    docs = frame(spark, clean + junk + other, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(900)] + [(1000 + i, 0) for i in range(60)] + [(5, 1), (7, None), (None, 1)], "doc_id long, quality int")
    got = collections.defaultdict(list)
    for r in quality_rules.quality_rules(docs, labels, alpha=0.02).collect():
        got[r.doc_id].append(r.kept)
    assert all(got[i] == [True] for i in range(900)) and all(got[1000 + i] == [False] for i in range(60))
    assert got[2000] == [True, True] and got[None] == [False] and got[2001] == [False]  # too few labels: only the base rule
    assert quality_rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_a_labelled_document_counts_once(spark):
    """900 rows of 30 texts are no 900 draws: no setting can be guaranteed."""
    rng = random.Random(3)
    texts = [prose(rng, 30) for _ in range(30)]
    rows = [(i, texts[i % 30], "en") for i in range(900)] + [(i, texts[0], "en") for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i in range(900)], "doc_id long, quality int")
    got = quality_rules.quality_rules(frame(spark, rows, "doc_id long, text string, lang string"), labels).select("cut").distinct().collect()
    assert [r.cut for r in got] == [-1]


# --- 2 ---------------------------------------------------------------------------------------------------------------


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_html_extraction(spark):
    rows = []
    for i in range(12):  # no article is marked: the site's own blocks are known by their recurrence
        rows.append((i, f"http://a.org/{i}", page(f"<div><div>Our site since 1999</div><div><p>Text &amp; number {i}<br>of many<p>second\n  {i}</div><div>All rights reserved</div></div>")))
    article = page("<header>H</header><nav><a>m</a></nav><div class='cookie-notice'>c</div><article><h1>A &eacute;</h1><p>quoted line<p>b<div class='comments'><p>bad</div></article><aside>s</aside><form><input>f</form><footer>x</footer>")
    rows += [(100 + i, "http://b.org/x", article) for i in range(6)] + [(200, None, None), (201, "http://a.org/z", ""), (202, "x", "plain <b unclosed"), (200, None, None)]
    got = collections.defaultdict(list)
    for r in html_extract.extract_main_text(frame(spark, rows, "page_id long, url string, html string")).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert all(got[i] == [f"Text & number {i} of many\nsecond {i}"] for i in range(12))
    assert all(got[100 + i] == ["A é\nquoted line\nb"] for i in range(6))
    assert got[200] == ["", ""] and got[201] == [""] and got[202] == ["plain"]
    assert html_extract.extract_main_text(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_html_recurrence_decides_on_pages_with_an_article(spark):
    menu = "<div><div>Home</div><div>Shop</div></div>"
    rows = [(i, f"http://c.org/{i}", page(f"{menu}<article><h1>Title {i}</h1><p>Some text {i}<p>{'A quotation' if i < 4 else f'No quotation {i}'}<p>Read our weekly letter</article>")) for i in range(10)]
    rows += [(20, "http://c.org/list", page(f"{menu}<div><p>No article here</div>"))]
    # one article under many urls, with dates around it: its paragraphs stay
    rows += [(30 + i, f"http://d.org/{i}", page(f"<div>Seen {i} times</div><article><p>Only text</article>")) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nSome text {i}\n" + ("A quotation" if i < 4 else f"No quotation {i}") for i in range(10))
    assert got[20] == "No article here"
    assert all(got[30 + i] == "Only text" for i in range(8))


def test_html_keeps_chapters_of_an_article(spark):
    body = "<article><section id='discussion'><h2 id='related-work'>Related work</h2><p class='alert'>Mind this</section><section id='ad-hoc-networks'>Ad hoc</section><p>By <math><mi>x</mi></math> and <object>a chart</object><div class='article-ad'>buy</div><div id='comments'>bad</div></article>"
    got = html_extract.extract_main_text(frame(spark, [(1, "http://e.org/", page(body))], "page_id long, url string, html string")).collect()
    assert got[0].text == "Related work\nMind this\nAd hoc\nBy x and a chart"


def test_html_templates_equal_brute_force(spark):
    """Random well-formed pages without any hint in the markup: subtrees are counted in Python, as nested tuples."""
    rng = random.Random(12)
    parts = [("div", [("p", [f"furniture {i}"]), ("ul", [("li", [f"a{i}"]), ("li", [f"b{i}"])])]) for i in range(6)]

    def tree(i):
        own = [("p", [f"own text {i} {j}"]) for j in range(rng.randrange(3))]
        body = [*rng.sample(parts, rng.randrange(4)), ("section", own + rng.sample(parts, 1)), ("p", [rng.choice(["often said", f"said once {i}"])])]
        rng.shuffle(body)
        return ("main-part", body)

    def write(node):
        return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(write, node[1])) + f"</{node[0]}>"

    def freeze(node):
        return node if isinstance(node, str) else (node[0], tuple(map(freeze, node[1])))

    def subtrees(node):
        if not isinstance(node, str):
            if node[1]:
                yield freeze(node)
            for x in node[1]:
                yield from subtrees(x)

    def texts(node, gone):
        if isinstance(node, str):
            return [node]
        return [] if freeze(node) in gone else [t for x in node[1] for t in texts(x, gone)]

    pages = [(i, f"http://h{i % 3}.org/{i}", ("div", tree(i)[1])) for i in range(40)]
    pages += [(100 + i, f"http://h0.org/again{i}", pages[0][2]) for i in range(5)]  # copies of a page do not count
    expected = {}
    for host in range(3):
        own = [(i, t) for i, u, t in pages if f"//h{host}." in u]
        seen = collections.defaultdict(set)
        for _, t in own:
            for x in subtrees(t):
                seen[x].add(tuple(texts(t, ())))
        gone = {x for x, prints in seen.items() if len(prints) >= html_extract.MIN_PAGES}
        expected |= {i: "\n".join(texts(t, gone)) for i, t in own}
    df = frame(spark, [(i, u, page(write(t))) for i, u, t in pages], "page_id long, url string, html string")
    for markup in (True, False):
        got = {r.page_id: r.text for r in html_extract.extract_main_text(df, markup=markup).collect()}
        assert got == expected
    assert any(expected.values()) and sum("furniture" in x for x in expected.values()) < len(expected) / 2


def test_html_markup_does_not_take_text():
    def kept(body):
        p = html_extract.Page(page(body))
        return [b for b, m, a in zip(p.blocks, p.marked, p.mains, strict=True) if not m and (a or not any(p.mains))]

    assert kept("<div class='content has-sidebar'><article><p>Text</article></div>") == ["Text"]
    assert kept("<div class='social-science'>Science</div>") == ["Science"]
    assert kept("<p>Read <button>Share this</button><label>Mail</label> on <select><option>x</select></p>") == ["Read on"]
    assert kept("<p>a <span class='advert'>BUY <span>now</span></span> b") == ["a b"]
    assert kept("<p>a<svg><p>rest <math><mi>x</mi></math> <object>o") == ["a", "rest x o"]
    assert kept("<noscript>off</noscript><p>k <noscript>rest") == ["k rest"]
    assert kept("<div class=comments><article><p>c</article></div><article><p>main</article>") == ["main"]
    assert kept("<p>a<button>b<p>c") == ["a", "c"]


def test_html_parser_survives_anything():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div", ">", "</div>", "<b>", "&amp;", "&#x41;", "text ", "<!-- c", "-->", "<script>", "</script>", "\"", "'", "<li>", "<td>", "</table>", "<article>", "</article>", "<br/>", "\x00"]
    for _ in range(300):
        html_extract.Page("".join(rng.choice(parts) for _ in range(rng.randrange(60))))
    deep = html_extract.Page("<div>x" * 3000)
    assert len(deep.blocks) == len(deep.elements) == 3000
    assert html.unescape("&amp;") == "&"


# --- 3 ---------------------------------------------------------------------------------------------------------------


def brute_url(url, rules, globs):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fit = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, rule, verdict = max(fit)
        return host, path, rule, verdict
    hit = [v for v, g in globs if re.fullmatch(".*".join(map(re.escape, g.split("*"))), path, re.S)]
    return host, path, None, "block" if "block" in hit else "allow"


def test_url_filter(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), *(("block", f"h{i}.net", f"/{i}") for i in range(40))]
    globs = [("block", "/ads/*"), ("block", "*.zip"), ("block", "*/a*b/c"), ("allow", "*ok*")]
    rng = random.Random(4)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "x://badexample.org/es/", "http://org", "http://com/x.org/es/", "http://www.com/de/?/fr/", "http://a.com/de", "ftp://É.com/fr/ü"]
    urls += [rng.choice(["http://", "https://www.", "a://b://"]) + rng.choice(["example.org", "X.example.org", "com", "h3.net", "w.h39.net", "net", "org.com"]) + rng.choice(["", "/", "/es/", "/en/12", "/fr/ads/", "/de/q.zip", "/39", "/ads/x", "/q/aab/c", "/okab/c"]) + rng.choice(["", "?u=/es/", "#x"]) for _ in range(400)] + ["http://x.net/" + "y" * 3000 + ".zip"]
    machine = [url_filter.rule(*x) for x in rules] + [url_filter.glob(*x) for x in globs]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(frame(spark, list(enumerate(urls)), "page_id long, url string"), machine).collect()}
    assert got == {i: brute_url(u, rules, globs) for i, u in enumerate(urls)}


# --- 4 ---------------------------------------------------------------------------------------------------------------


def edit_distance(pattern, text):
    """The least edit distance of a pattern to a substring of a text, by the plain program."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def holds(item, text):
    width = min(decontaminate.WIDTH, len(item))
    edits, _ = decontaminate.budget(width)
    return any(edit_distance(item[w : w + width], text) <= edits for w in range(len(item) - width + 1))


def test_one_slice_of_the_benchmark_is_held(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, prose(rng, 12)) for i in range(200)]
    docs = [(i, prose(rng, 5) + " " + items[i][1] + " " + prose(rng, 5)) for i in range(0, 200, 10)]
    held, most, real = [], [], spark.sparkContext.broadcast

    def recorded(value):
        if isinstance(value, list):  # a slice
            held.append(real(value))
            most.append(sum(os.path.exists(b._path) for b in held if b._path))
            return held[-1]
        return real(value)

    monkeypatch.setattr(spark.sparkContext, "broadcast", recorded)
    rows = decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), slice_bytes=2000)
    assert {(r.doc_id, r.item_id) for r in rows.collect()} == {(i, i) for i in range(0, 200, 10)}
    assert len(held) > 5 and max(most) <= 1


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(5, 16))) for i in range(10)] + [(50, "too short"), (51, None), (52, "")]
    docs, expected = [], set()
    for i in range(48):
        text = prose(rng, rng.randrange(2, 12))
        if i % 2 == 0:
            item, passage = rng.choice(items[:10])
            at = rng.randrange(max(1, len(passage) - 50))
            piece = list(passage[at : at + rng.choice([40, 48, 48, 60])])
            for _ in range(rng.randrange(6)):
                place = rng.randrange(len(piece))
                piece[place : place + rng.randrange(2)] = rng.choice(["x", "yz", ""])
            text = text + " " + "".join(piece).upper() + "\n " + text
        docs.append((i, text))
    for i, text in docs:
        for item, passage in items:
            p = decontaminate.normalise(passage)
            if len(p) >= decontaminate.LEAST and holds(p, decontaminate.normalise(text)):
                expected.add((i, item))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for slice_bytes in (1 << 20, 300):
        rows = decontaminate.find_leaks(frame(spark, [*docs, (900, None), (901, "")]), benchmark, slice_bytes=slice_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == expected and len(expected) > 10
    long = prose(rng, 40_000) + " " + items[3][1] + " " + prose(rng, 5)
    assert [r.item_id for r in decontaminate.find_leaks(frame(spark, [(1, long)]), benchmark).collect()] == [3]
    assert decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("kind", ["change", "insert", "delete", "mixed"])
def test_spans_at_the_full_budget_are_found(kind):
    """Every 48-byte span of an item with 3 edits anywhere, in a long text."""
    rng = random.Random(5)
    item = decontaminate.normalise(prose(rng, 40))
    index, docs = decontaminate.Index([item]), []
    for at in range(len(item) - 47):
        span = list(item[at : at + 48])
        for place in sorted(rng.sample(range(48), 3), reverse=True):
            how = rng.choice(["change", "insert", "delete"]) if kind == "mixed" else kind
            span[place : place + (how != "insert")] = [] if how == "delete" else [35]
        docs.append(prose(rng, 8).encode() + b" " + bytes(span) + b" " + prose(rng, 8).encode())
    assert {d for d, *_ in decontaminate.search(index, docs)} == set(range(len(docs)))


def test_items_with_one_stem_and_repetitive_items():
    import time

    rng = random.Random(1)
    stem = "which of the following statements about the subject given below is the correct one, and why: "
    items = [decontaminate.normalise(stem + prose(rng, 6)) for _ in range(20_000)]
    text = decontaminate.normalise(prose(rng, 20) + " " + stem[40:] + prose(rng, 20))
    began = time.time()
    parts = list(decontaminate.indexes(list(enumerate(items))))
    hits = [h for index in parts for h in decontaminate.search(index, [text])]
    assert len(parts) > 1 and {i for _, i, *_ in hits} == set(range(20_000)) and time.time() - began < 120
    runs = [b"a" * 20_000, b"ab" * 3000]
    parts = list(decontaminate.indexes(list(enumerate(runs))))
    assert {(d, i) for index in parts for d, i, *_ in decontaminate.search(index, [b"x" + b"a" * 60, b"ba" * 500, b"aab" * 90])} == {(0, 0), (1, 1)}


def test_short_items_are_found_whole(spark):
    items = [(1, "Who is it?"), (2, "cat"), (3, "漢字"), (4, "x"), (5, "a quotation of 23 bytes"), (6, " "), (7, "12345678"), (8, "who  is IT?")]
    docs = [(1, "so: WHO is\nit? A cat."), (2, "concatenate 123456789 who is"), (3, "本漢字本"), (4, "cat x cat"), (5, "say a quotation of 23 bytes"), (6, "a quotation of 24 bytes"), (7, "12345678"), (8, ""), (9, None)]
    got = {(r.doc_id, r.item_id): (r["first"], r.end, r.edits) for r in decontaminate.find_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    assert got == {(1, 1): (4, 14, 0), (1, 8): (4, 14, 0), (1, 2): (17, 20, 0), (3, 3): (3, 9, 0), (4, 2): (0, 9, 0), (4, 4): (4, 5, 0), (5, 5): (4, 27, 0), (7, 7): (0, 8, 0)}


def test_banded_alignment_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(60):
        item = "".join(rng.choice("abcd") for _ in range(rng.randrange(24, 60))).encode()
        text = list(item[:48])
        for _ in range(rng.randrange(5)):
            place = rng.randrange(len(text))
            text[place : place + rng.randrange(2)] = rng.choice([b"", b"x"])
        text = b"xyz" + bytes(text) + b"zyx"
        index, pad = decontaminate.Index([item]), b"\n" * 60
        cost, end = decontaminate.align(index, np.array([0]), np.array([0]), np.frombuffer(pad + text + pad, np.uint8), np.array([60]))
        real = edit_distance(item[:48], text)
        assert cost[0] == min(real, decontaminate.EDITS + 1)
        assert real > decontaminate.EDITS or edit_distance(item[:48], text[: end[0] - 60]) == real


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = [None, "", " ", "it's  123\n\n  don't 漢字 éa\u0301!!", "a" * 70_000, " " * 40_000 + "x", "".join(rng.choice("ab 1é'\n!") for _ in range(150_000)), "<|endoftext|>"]
    got = {r.doc_id: r for r in bpe.bpe_round_trip(frame(spark, list(enumerate(texts))), path, P.PATTERN, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk", [16, 40, 64])
def test_chunks_are_stitched(chunk):
    import public_tokenizers as P
    import regex

    pattern, rng, met = regex.compile(P.PATTERN), random.Random(chunk), 0
    for _ in range(600):
        text = "".join(rng.choice(["a", "b ", "  ", "\n", "'s", "'", "1", "é", " ", "!", "漢", "\u0301", "'ll", "re"]) for _ in range(rng.randrange(200)))
        found = bpe.pieces(text, pattern, chunk, rng.choice([2, 4]))
        met += found is not None
        assert found is None or found == pattern.findall(text)
    assert met > 300


def test_texts_of_many_chunks(spark):
    """Chunks as rows give what one search over the whole text gives; copies and texts that cannot be stitched too."""
    import public_tokenizers as P

    rng = random.Random(2)
    texts = [prose(rng, 300), "x" * 900, prose(rng, 80) + " " * 500 + prose(rng, 80), None, "short", *[prose(rng, 200)] * 3]
    df, path = frame(spark, list(enumerate(texts))), P.path("byte_bpe_50k.tiktoken")
    plain, cut = (sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in bpe.bpe_round_trip(df, path, P.PATTERN, keep_ids=True, chunk=c, overlap=o).collect()) for c, o in ((1 << 20, 512), (100, 20)))
    assert plain == cut and len(cut) == len(texts)


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_chats(spark):
    turn = lambda c, n, t, role="user": (c, n, role, t)
    rows = [turn(1, 0, "a"), turn(2, 0, "a"), turn(2, 1, "b", "assistant"), turn(3, 0, "a"), turn(3, 1, "b", "assistant"), turn(4, 0, "a"), turn(4, 1, "c"), turn(5, 0, None), turn(6, 0, ""), turn(7, 0, "x", None), turn(None, 0, "n"), turn(8, None, "q"), turn(8, 5, "r"), turn(9, 0, "ab"), *(turn(10, i, f"m{i}") for i in range(600)), *(turn(11, i, f"m{i}") for i in range(300))]
    got = {(r.conv_id, r.part): r for r in format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k[0] for k in got} == {2, 4, 5, 6, 7, None, 8, 9, 10}
    assert got[2, 0].n_copies == 2 and got[2, 0].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert [got[10, i].rendered.count("<|im_start|>") for i in range(3)] == [256, 256, 88]
    assert format_chats(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    emission, move = rng.normal(size=5), rng.normal(size=(2, 2))
    total, ones = 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> i) & 1 for i in range(5)]
        w = math.exp(sum(e for e, s in zip(emission, y, strict=True) if s) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        ones += w * np.array(y)
    odds, _, _ = toxicity.marginals(emission, np.array([0, 5]), move)
    assert np.allclose(1 / (1 + np.exp(-odds)), ones / total)


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randrange(20, 120)).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["Nastyword,", "vile" + rng.choice(["ly", "st", "ness"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (900, None), (None, "nastyword nastyword vilest word here"), (902, prose(rng, 50_000) + " vilest nastyword")]
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels[:400] + [(3, None)], "doc_id long, toxic int"), "doc_id", "text")
    scored = toxicity.score_toxicity(docs, model).collect()
    got = {r.doc_id: r for r in scored}
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    right = sum(got[i].predicted == y for i, y in labels[400:])
    assert right >= 190 and got[None].predicted == 1 and got[901].predicted == 0
    assert got[902].spans[-1].end == len(rows[-1][1])
    i = next(i for i, y in labels[400:] if y and got[i].predicted)
    assert all(any(s in rows[i][1][x["first"] : x["end"]].lower() for s in ("nasty", "vile")) for x in got[i].spans)
    toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "text")


# --- 10 --------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    """Python's version of the chunking and of what goes."""
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    split, first, out = [], {}, []
    for doc, text in rows:
        lines, chunks, now, before = (text or "").split("\n"), [], [], ""
        for line in lines:
            now.append(line)
            if digest(before + digest(line))[-1] in "048c":
                chunks.append(now)
                now = []
            before = digest(line)
        split.append((doc, text or "", chunks + [now] * bool(now)))
    for doc, text, chunks in split:
        for i, c in enumerate(chunks):
            if sum(bool(x.strip(" \r\t")) for x in c) > 1:
                key = (doc is None, doc or 0, bytes.fromhex(digest(text)), i)
                body = "\n".join(c)
                first[body] = min(key, first.get(body, key))
    for doc, text, chunks in split:
        keep = [c for i, c in enumerate(chunks) if sum(bool(x.strip(" \r\t")) for x in c) < 2 or first["\n".join(c)] == (doc is None, doc or 0, bytes.fromhex(digest(text)), i)]
        kept = "\n".join("\n".join(c) for c in keep)
        out.append((doc if doc is not None else -1, kept, sum(map(len, chunks)), sum(map(len, chunks)) - sum(map(len, keep))))
    return sorted(out)


def test_line_dedup(spark):
    rng = random.Random(11)
    shared = [prose(rng, 6) for _ in range(40)]
    rows = []
    for i in range(50):
        lines = [prose(rng, 5) for _ in range(rng.randrange(12))]
        a = rng.randrange(30)
        at = rng.randrange(len(lines) + 1)
        rows.append((i, "\n".join(lines[:at] + shared[a : a + rng.randrange(12)] + lines[at:])))
    rows += [(70, rows[3][1]), (71, None), (72, ""), (73, "one line"), (74, "\n\n \n"), (75, "\n".join(shared * 3)), (3, rows[3][1]), (None, rows[4][1]), (76, "é\r\n" * 2000)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(frame(spark, rows).withColumns({c: F.lit("x") for c in ("n_lines", "n_removed", "text_", "hash", "rest")})).collect())
    assert got == brute_lines(rows)
    assert sum(r[3] for r in got) > 50
    assert line_dedup(frame(spark, [])).count() == 0


def brute_passages(rows):
    """Pairs of successive non-blank lines; the first occurrence of each keeps its lines."""
    split, first, out = [], {}, []
    for doc, text in rows:
        lines = (text or "").split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" \r\t")]
        key = (doc is None, doc or 0, hashlib.md5((text or "").encode()).digest())
        pairs = [("\n".join(lines[a : b + 1]), range(a, b + 1), (key, i)) for i, (a, b) in enumerate(zip(solid, solid[1:]))]
        split.append((doc, lines, pairs))
        for body, _, at in pairs:
            first.setdefault(body, set()).add(at)
    for doc, lines, pairs in split:
        dead = {i for body, span, at in pairs if at != min(first[body]) for i in span}
        dead -= {i for body, span, at in pairs if at == min(first[body]) and len(first[body]) > 1 for i in span}
        out.append((-1 if doc is None else doc, "\n".join(x for i, x in enumerate(lines) if i not in dead), len(lines), len(dead)))
    return sorted(out)


def test_passages_of_two_lines_are_found(spark):
    rng = random.Random(13)
    shared = [prose(rng, 6) for _ in range(60)]
    rows = []
    for i in range(60):
        lines = [prose(rng, 5) for _ in range(1 + rng.randrange(12))]
        a, at = rng.randrange(50), rng.randrange(len(lines) + 1)
        rows.append((i, "\n".join(lines[:at] + shared[a : a + rng.randrange(5)] + [""] * rng.randrange(2) + lines[at:])))
    rows += [(70, rows[3][1]), (71, None), (72, ""), (73, "one line"), (74, "\n\n \n"), (75, "\r\nx\r"), (78, "\r\nx\r"), (3, rows[3][1]), (None, rows[4][1]), (76, "é\r\n" * 2000), (77, "a\nb\n\nc"), (79, "b\n\nc\nd")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(frame(spark, rows), passages=True).collect())
    assert got == brute_passages(rows)
    assert sum(r[3] for r in got) > 50


def test_pipeline_removes_every_short_passage(spark):
    import corpus_pipeline

    rng = random.Random(14)
    rows = []
    for i in range(20):  # a passage of two lines in two documents, between other lines
        passage = prose(rng, 6) + "\n" + prose(rng, 6)
        rows += [(k, f"{prose(rng, 5)}\n{passage}\n{prose(rng, 5)}", passage) for k in (i, 100 + i)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert all((p in got[i]) == (i < 100) for i, _, p in rows)
    assert all(got[i].count("\n") == (3 if i < 100 else 1) for i, _, _ in rows)


# --- pipeline --------------------------------------------------------------------------------------------------------


def brute_quality(rows, good):
    """Ids that the base rule and the cutoffs keep; one stratum."""
    levels, kept = {}, []
    for i, text in rows:
        c = {k: int(v[0]) for k, v in quality_rules.base_counts(pa.array([text or ""])).items()}  # tested against plain counts above
        base = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        metrics = (1000 * c["n_symbols"] // max(c["word_chars"], 1), 1000 * c["n_dup_lines"] // max(c["n_lines"], 1), 1000 * c["n_repeat_words"] // max(c["n_words"], 1))
        level = min([k for k, cut in enumerate(quality_rules.LEVELS) if any(m > x for m, x in zip(metrics, cut))], default=len(quality_rules.LEVELS))
        levels[i] = (base, level, text)
    drawn = {t: lv for i, (base, lv, t) in levels.items() if i in good and not base}
    cut = -1
    for k in range(len(quality_rules.LEVELS)):
        errors = sum(lv <= k for lv in drawn.values())
        tail = sum(math.comb(len(drawn), x) * quality_rules.ALPHA**x * (1 - quality_rules.ALPHA) ** (len(drawn) - x) for x in range(errors + 1))
        if errors > quality_rules.ALPHA * len(drawn) or tail > quality_rules.DELTA:
            break
        cut = k
    for i, text in rows:
        base, level, _ = levels[i]
        if not base and level > cut:
            kept.append((i, text))
    return kept


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(21)
    shared = [prose(rng, 7) for _ in range(12)]
    texts = ["\n".join(prose(rng, 9) for _ in range(rng.choice([2, 4, 12]))) for _ in range(330)]
    for i in range(0, 330, 6):
        texts[i] += "\n" + "\n".join(shared[i % 9 : i % 9 + rng.randrange(1, 4)])
    items = [prose(rng, 12) for _ in range(4)]
    for i in range(40):
        words = texts[rng.randrange(300)].split(" ")
        words[rng.randrange(len(words))] = f"q{i}"
        texts.append(" ".join(words))
    texts += [prose(rng, 12) + " " + rng.choice(items)[: rng.choice([50, 70])] for _ in range(12)] + [texts[1], texts[2], None, "", "few", " ".join(w + "##" for w in texts[5].split())]
    rows = list(enumerate(texts))
    good = set(range(330))
    names = {c: F.lit("mine") for c in ("row_key", "pair", "lines_before", "n_removed", "root", "node", "id")}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).withColumns(names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in good), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = brute_quality(rows, good)
    chunked = brute_lines(left)
    lost = {i for i, _, _, n in chunked if n}
    left = [(i, t) for i, t, _, n in brute_passages([(i, t) for i, t, _, _ in chunked]) if t.strip() or not (n or i in lost)]
    left = [(i, t) for (i, t), (_, _, c) in zip(sorted(left), brute_components(sorted(left)), strict=True) if i == c]
    passages = [decontaminate.normalise(x) for x in items]
    common = lambda p, t: sum(p[k : k + 8] in t for k in range(len(p) - 7))
    # 3 edits spoil at most 24 of a window's 41 grams
    leaks = {i for i, t in left for p in passages if common(p, decontaminate.normalise(t)) >= 17 and holds(p, decontaminate.normalise(t))}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    expected = {i: library.encode_ordinary(t) for i, t in left if i not in leaks}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == expected
    assert leaks and len(got) < len(rows) - 8
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.where("row_key <> 'mine' or pair <> 'mine' or lines_before <> 'mine'").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [prose(rng, 60).replace(" ", "\n", 3) for _ in range(500)]
    item = prose(rng, 40)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    extra = {600: "few words", 601: " ".join(w + "###" for w in texts[0].split()), 602: texts[1], 603: texts[2] + " tail", 604: prose(rng, 30) + " " + item, 605: None}
    rows += [(k, t, "en", "s", len(t or "")) for k, t in extra.items()] + [rows[7]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 500), 0) for i in range(606)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(500))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, str(tmp_path))
        assert docs_after.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


# --- what the markup and the labels leave open ------------------------------------------------------------------------


def kept_of(page):
    p = html_extract.Page(page)
    only = any(p.mains)
    return [b for b, m, a in zip(p.blocks, p.marked, p.mains, strict=True) if not (m or only and not a)]


def test_wrappers_around_the_page():
    assert kept_of('<form id="f"><div><article><p>Text</article></div></form>') == ["Text"]
    assert kept_of("<form><div><p>Most of the text of the page</div></form><nav>menu</nav>") == ["Most of the text of the page"]
    assert kept_of("<fieldset><menu><p>Most of the text of the page</menu></fieldset>") == []  # two of them: a form indeed
    assert kept_of("<p>A long text of the page, the longest of all</p><form><p>Search here</form>") == ["A long text of the page, the longest of all"]
    assert kept_of("<nav><form><article><p>Text</article></form></nav><p>Rest") == ["Rest"]


def test_notices_inside_an_article():
    named = "".join(f'<div class="{c}"><p>gone</div>' for c in ("newsletter", "share", "related-posts", "cookie-notice", "pagination", "social-bar"))
    assert kept_of(f'<article><p>Body</p>{named}<section class="related-work"><p>Stays</section><div class="ad-hoc">too</div></article>') == ["Body", "Stays", "too"]


def test_chats_without_turn_numbers(spark):
    """Turns without numbers are cut into blocks by place, and rendered in parts like any other."""
    rows = [("a", None, "user", f"{i:05d}") for i in range(700)] + [("b", 7, "user", f"{i:05d}") for i in range(300)] + [(None, None, None, f"n{i}") for i in range(3)]
    got = format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    parts = collections.defaultdict(dict)
    for r in got:
        parts[r.conv_id][r.part] = r.rendered
    assert set(parts) == {"a", None} and set(parts["a"]) == {0, 1, 2}  # "b" is a prefix of "a"
    assert "".join(parts["a"][i] for i in range(3)) == "".join(f"<|im_start|>user\n{i:05d}<|im_end|>\n" for i in range(700))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, ""), (3, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "text")
    assert all(r.predicted == 0 and 0 <= r.score < 0.3 for r in toxicity.score_toxicity(docs, model).collect())
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0
