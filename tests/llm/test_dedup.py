import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import graph, html_extract, ivfpq, minhash, page_layouts, substring_dedup
from siltstone.llm.shingles import shingles, word_hashes
from tests.compare import same
from tests.llm.helpers import DOCS, ODD, frame, prose, rows, words


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in brute_components(nodes, [e for e in edges if e[0] != e[1]]).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_are_the_contract_s():
    texts = [t or "" for t in ODD] + ["A\x0bB\x0cC \x1c D E", "Ünder ÄB", "a" * 3_000_000 + " b", "w " * 800_000]
    for t, h in zip(texts, word_hashes(texts), strict=True):
        w = words(t)
        assert len(h) == len(w)
        first: dict = {}
        assert all(first.setdefault(x, y) == y for x, y in zip(w[:2000], h[:2000].tolist(), strict=True)) and len(set(first.values())) == len(first)
    assert len(shingles(word_hashes(["a b"])[0], 3)) == 1 and len(shingles(word_hashes(["a b c d"])[0], 3)) == 2


def near(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


def corpus(rng):
    base = [prose(rng, "en", rng.choice([8, 20, 150, 400])) for _ in range(30)]
    texts = ODD + base + [near(rng, rng.choice(base), rng.choice([0, 1, 2, 4])) for _ in range(120)]
    hot = prose(rng, "de", 150)
    return texts + [near(rng, hot, rng.choice([0, 0, 1, 2, 3, 4, 5, 8])) for _ in range(150)]


@pytest.mark.parametrize(("k", "least"), [(3, 85), (5, 80)])
def test_minhash_by_brute_force(spark, k, least):
    texts = corpus(random.Random(2))
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    want = brute_components(sets, linked)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows(texts)), k, least).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_minhash_finds_links_that_stars_miss(spark):
    """A chain in one bucket: the first is linked with the second alone, the second with the third."""
    rng = random.Random(9)
    w = prose(rng, "en", 300).split()
    texts = []
    for step in range(6):
        texts.append(" ".join(w[: 300 - 22 * step] + [f"new{j}" for j in range(22 * step)]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows(texts))).collect()}
    assert set(got.values()) == {0}


def test_minhash_of_repeated_rows_ties_and_null_ids(spark):
    rng = random.Random(23)
    a, b = prose(rng, "en", 60), prose(rng, "en", 60)
    long_ = prose(rng, "de", 60_000)
    assert len(long_) > 1 << 18
    data = [*rows([a, b, a, long_, None]), *rows(["short", None, None, long_ + " more", "x"]), (None, a, None, None, 1, "x", "y", "z", 1), (7, long_, None, None, 1, "x", "y", "z", 1)]
    got = minhash.near_duplicates(frame(spark, data)).collect()
    by = {r.doc_id: r for r in got}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [0, 1, 2, 3, 4, 7] and len(got) == 7
    assert by[2].component_id == 0 and by[7].component_id == 3 and not by[2].kept and by[0].kept and by[1].kept
    assert by[0].n_shingles == 58 and by[4].n_shingles == 1 and by[None].component_id is None and by[None].kept


def test_minhash_equals_its_sql(spark, sf):
    same(minhash.op10_minhash(spark, sf), minhash.OP10_SQL, sf)


def test_set_links_are_exact():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    y = [np.unique(rng.integers(0, 60, 40)) for _ in range(20)]
    want = [[100 * len(set(a) & set(b)) >= 50 * len(set(a) | set(b)) for b in y] for a in x]
    assert (minhash.set_links(x, y, 50) == np.array(want)).all()


# ---- passages
def test_passages_by_brute_force(spark):
    rng = random.Random(3)
    shared = [prose(rng, "en", 80).split() for _ in range(6)]
    texts, planted = list(ODD), {}
    for i in range(90):
        w = prose(rng, rng.choice(["en", "de"]), rng.randint(60, 300)).split()
        if i % 3 == 0:
            p = list(rng.choice(shared))
            if i % 2:
                p[rng.randrange(20, 60)] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = p
            planted[len(texts)] = (at, " ".join(p))
        texts.append(" ".join(w))
    docs = frame(spark, rows(texts))
    got = substring_dedup.passages(docs).collect()
    owners = {}
    for i, (_, p) in sorted(planted.items()):
        owners.setdefault(p.replace("changed", "")[:40], i)
    must = {i for i in planted if any(i > j and len(set(planted[i][1].split()) & set(planted[j][1].split())) > 40 for j in planted)}
    found = {r.doc_id for r in got}
    assert must <= found
    long = {i for i, t in enumerate(texts) if t and len(words(t)) >= 50 and any(texts[j] == t for j in range(i))}
    assert found <= must | long
    for r in got:
        assert r.n_words == r.end_word - r.start_word >= 50 and 0.8 <= r.identity <= 1 and r.source_doc_ids and r.doc_id not in r.source_doc_ids
        if r.doc_id in planted:
            at = planted[r.doc_id][0]
            assert abs(r.start_word - at) <= 15 and abs(r.end_word - at - 80) <= 15
    assert substring_dedup.passages(spark.createDataFrame([], DOCS)).count() == 0


def edited(rng, w, share):
    """Words with a share of them replaced, the first and last three kept."""
    w = list(w)
    for i in rng.sample(range(3, len(w) - 3), round(share * len(w))):
        w[i] = "edit" + str(rng.randrange(10**6))
    return w


def test_passages_with_many_edits(spark):
    """Each edited copy keeps a chain, as by brute force; a passage whose edited ends are trimmed may be short of min_words."""
    rng = random.Random(11)
    texts, where = [], {}
    for share in (0.1, 0.15, 0.2):
        for n in (50, 55, 60):
            for _ in range(20):
                w = [f"w{rng.randrange(10**7)}" for _ in range(n)]
                for x in (w, edited(rng, w, share)):
                    texts.append(" ".join([*(f"a{rng.randrange(10**7)}" for _ in range(40)), *x, *(f"b{rng.randrange(10**7)}" for _ in range(40))]))
                where[len(texts) - 1] = n
    docs = frame(spark, rows(texts))
    grams = [{tuple(w[i : i + 5]): i for i in range(len(w) - 4)} for w in map(str.split, texts)]
    shared = {d: [i for g, i in grams[d].items() if g in grams[d - 1]] for d in where}
    want = {d for d, at in shared.items() if at and max(at) - min(at) >= 5}
    chained = {r.doc for r in substring_dedup.chains_of(substring_dedup.matches_of(docs)).collect()}
    assert len(want & chained) >= 0.99 * len(where)
    got = {r.doc_id: r for r in substring_dedup.passages(docs).collect()}
    assert set(got) <= set(where) and len(got) >= 0.8 * len(where)
    assert all(r.source_doc_ids == [d - 1] and 40 <= r.start_word and r.end_word <= 40 + where[d] for d, r in got.items())


@pytest.mark.parametrize(("lines", "n"), [(3, 18), (4, 15), (5, 12)])
def test_passages_of_lines_with_other_owners(spark, lines, n):
    """Each line of a passage occurs earlier in a document of its own; the two later holders of all of it still meet."""
    rng = random.Random(12)
    new = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    first, later = [], []
    for _ in range(25):
        own = [new(n) for _ in range(lines)]
        first += [[*new(30), *x, *new(30)] for x in own]
        whole = sum(own, [])
        later += [[*new(30), *whole, *new(30)], [*new(30), *whole, *new(30)]]
    texts = [" ".join(w) for w in first + later]
    got = {r.doc_id: r for r in substring_dedup.passages(frame(spark, rows(texts))).collect()}
    want = range(len(first) + 1, len(texts), 2)
    assert all(d in got and got[d].n_words == lines * n and d - 1 in got[d].source_doc_ids for d in want)


def test_passages_of_short_texts_alone(spark):
    assert substring_dedup.passages(frame(spark, rows(["one two", "one two", "", "three four five six"]))).count() == 0


def test_passages_need_one_source(spark):
    """Less than min_words of each of four documents make no passage, though they follow each other."""
    rng = random.Random(21)
    parts = [prose(rng, "en", 22) for _ in range(4)]
    texts = [prose(rng, "de", 40) + " " + p + " " + prose(rng, "de", 40) for p in parts] + [" ".join(parts)]
    assert substring_dedup.passages(frame(spark, rows(texts))).count() == 0


def test_passages_of_repeated_ids_and_long_matches(spark, monkeypatch):
    rng = random.Random(22)
    long_ = prose(rng, "en", 900)
    words_ = long_.split()
    # earlier owners of stretches of 45 words, so that the long match has anchors at both ends alone
    owners = [prose(rng, "de", 30) + " " + " ".join(words_[i : i + 45]) + " " + prose(rng, "de", 30) for i in range(60, 840, 40)]
    texts = [*owners, long_, prose(rng, "de", 20) + " " + long_]
    monkeypatch.setattr(substring_dedup, "REACH", 7)
    got = substring_dedup.passages(frame(spark, rows(texts))).collect()
    last = [r for r in got if r.doc_id == len(texts) - 1]
    assert [(r.start_word, r.end_word) for r in last] == [(20, 920)] and len(texts) - 2 in last[0].source_doc_ids
    # a doc_id with a long and a short row: the long one counts, and is cut
    docs = frame(spark, [*rows(["a b c", long_ + " tail words", prose(rng, "de", 90)]), *rows([long_]), (None, long_, None, None, 1, "x", "y", "z", 1)])
    found = substring_dedup.passages(docs)
    assert [(r.doc_id, r.n_words) for r in found.collect()] == [(1, 900)]
    left = {(r.doc_id, r.text) for r in substring_dedup.without_passages(docs, found).collect()}
    assert left == {(0, "a b c"), (0, long_), (1, "tail words"), (2, docs.where("doc_id = 2").first().text), (None, long_)}


def test_cutting_leaves_the_rest(spark):
    rng = random.Random(4)
    p = prose(rng, "en", 70)
    texts = ["Head one. " + p + " Tail one.", "Other head\n" + p + "\nother tail", p, None, "short"]
    docs = frame(spark, rows(texts))
    left = {r.doc_id: r for r in substring_dedup.without_passages(docs, substring_dedup.passages(docs)).collect()}
    assert left[0].text == texts[0] and left[1].text == "Other head\nother tail" and left[1].n_chars == len(left[1].text)
    assert 2 not in left and left[3].text is None and left[4].text == "short" and list(left[0].asDict()) == docs.columns


def test_chains_follow_order_and_gaps():
    p = np.array([0, 10, 20, 30, 40, 200, 210])
    q = np.array([100, 110, 121, 5, 140, 300, 310])
    got = sorted(sorted(c.tolist()) for c in substring_dedup.chains(p, q))
    assert [0, 1, 2, 4] in got and [5, 6] in got and [3] in got


# ---- pages
PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><div id="cookie-notice">We use cookies</div>
<header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- c --><div class="ad">Buy now, a long text of an advert that goes on</div>
<article><h1>Title &amp; more</h1><p>First  <b>bold</b>text&nbsp;here.<br>Next<p>Second &lt;x&gt; paragraph that is long enough.</p><form><input><button>Send it</button></form><ul><li>one<li>two</ul></article>
<aside>Side bar</aside><section class="comments"><article><p>A reader says a lot of words about this here article.</p></article></section><footer>&copy; x</footer></body></html>"""


def test_page_text():
    assert html_extract.main_text(PAGE) == "Title & more First boldtext here. Next Second <x> paragraph that is long enough. one two"
    for odd in (None, "", "   ", "<", "<p", "<!-- never closed", "<script>x", "</p></div>", "<html><head><title>t", "&amp", "<a href='x>y"):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("<article><p>cut off &am") == "cut off &am"
    long = "<article>" + "".join(f"<p>paragraph number {i} of very many</p>" for i in range(5000)) + "</article>"
    assert html_extract.main_text(long).count("paragraph") == 5000
    deep = "<div>" * 3000 + "<article><p>deep text in here</p></article>"
    assert html_extract.main_text(deep) == "deep text in here"


def test_main_text_of_layouts_that_were_not_fitted():
    """Against the labels of generated pages: what a brute-force reading of their words gives."""
    right = wrong = missed = whole = 0
    for html, is_text in page_layouts.labelled_pages(seed=77, pages=200):
        blocks = html_extract.blocks_of(html)[0]
        want = " ".join(b.text for b in blocks if is_text(b.text))
        got = html_extract.main_text(html)
        whole += got == want
        n = len(set(got.split()) & set(want.split()))
        right, wrong, missed = right + n, wrong + len(set(got.split())) - n, missed + len(set(want.split())) - n
    assert wrong < 0.02 * right and missed < 0.02 * right and whole > 120


def test_main_text_of_hard_pages():
    long = "This paragraph says something of some length about a subject that people read, and it ends here."
    assert html_extract.main_text(f"<html><head><title>t</title><meta charset=x><body><p>{long}</p><p>{long}</p>") == f"{long} {long}"
    assert html_extract.main_text(f"<html><head><title>t</title><p>{long}</p>") == long
    form = f"<body><form action='/x'><div><nav><a href=/>home page</a></nav><h1>A heading of it</h1>" + f"<p>{long}</p>" * 5 + "</div></form>"
    assert html_extract.main_text(form) == " ".join(["A heading of it", *[long] * 5])
    assert html_extract.main_text("<body><div class='social-history'>" + f"<p>{long}</p>" * 5 + "</div>") == " ".join([long] * 5)
    assert html_extract.main_text(f"<body><div><p>{long}</p><p>Only three words.</p><p>{long}</p></div>") == f"{long} Only three words. {long}"
    assert html_extract.main_text(f"<article><p>{long}</p><div class='comments'><p>{long} No.</p></div><p hidden>{long}</p></article>") == long


def test_long_broken_pages_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        start = time.process_time()
        text = html_extract.main_text("<article>" + "".join(f"<div>word{i} some text" for i in range(n)))
        took.append(time.process_time() - start)
        assert text.count("word") == n
    assert took[1] < 12 * max(took[0], 0.05)


def test_min_cut_by_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        src, snk = [rng.choice([0, 0, rng.random() * 3]) for _ in range(n)], [rng.choice([0, 0, rng.random() * 3]) for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(keep, src=src, snk=snk, edges=edges):
            return sum(src[i] for i, k in enumerate(keep) if not k) + sum(snk[i] for i, k in enumerate(keep) if k) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.min_cut(src, snk, edges)) - best) < 1e-6


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (3, "v", "", 5)], "page_id long, url string, html string, text int")
    got = html_extract.extract(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id > 1} == {""}
    assert html_extract.extract(df.limit(0)).count() == 0


# ---- vectors
def vectors(spark, m, odd=True):
    data = [(i, [float(x) for x in v], "a", 1) for i, v in enumerate(m)]
    n = len(data)
    if odd:
        data += [(n, None, "a", 1), (n + 1, [], "a", 1), (n + 2, [0.0] * m.shape[1], "a", 1), (n + 3, [float("nan")] * m.shape[1], "a", 1), (n + 4, [None] * m.shape[1], "a", 1), (n + 5, [1.0], "a", 1), (n + 6, [float("inf")] + [0.0] * (m.shape[1] - 1), "a", 1)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, rep string, list int").repartition(3), n


def clustered(seed, n=600, dim=24):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype(np.float32)
    m[n // 2 :] = m[rng.integers(0, 20, n - n // 2)] + rng.normal(size=(n - n // 2, dim)).astype(np.float32) * 0.05
    m[40:60] = m[5] * 2
    m[60:90] = m[6]
    return m


def test_vector_links_by_brute_force(spark):
    m = clustered(1)
    df, n = vectors(spark, m)
    x = m.astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = brute_components(range(n), [(int(i), int(j)) for i, j in zip(*np.nonzero(link), strict=True)])
    got = {r.vec_id: r for r in ivfpq.near_duplicates(df).collect()}
    assert len(got) == n + 7
    links = np.array([got[i].n_links for i in range(n)])
    assert (links <= link.sum(1)).all() and links.sum() >= 0.99 * link.sum()
    assert sum(got[i].component_id == want[i] for i in range(n)) >= 0.99 * n
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and all(got[i].n_links == 0 and got[i].kept for i in range(n, n + 7))
    assert ivfpq.near_duplicates(df.limit(0)).count() == 0 and ivfpq.near_duplicates(df.where(F.col("vec_id") >= n)).count() == 7


def test_vectors_of_several_sizes_and_repeated_rows(spark):
    rng = np.random.default_rng(9)
    wide = [[float(x) for x in v] for v in rng.normal(size=(40, 16))]
    wide[7] = wide[3]
    data = [(i, v) for i, v in enumerate(wide)] + [(100, [1.0, 2.0]), (101, [2.0, 4.0]), (102, [-1.0, 2.0]), (103, [1.0]), (3, wide[3])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    rows_ = ivfpq.near_duplicates(df).collect()
    assert len(rows_) == len(data)
    got = {r.vec_id: r for r in rows_}
    assert (got[100].n_links, got[101].n_links, got[101].component_id, got[102].n_links, got[103].n_links) == (1, 1, 100, 0, 0)
    assert got[7].component_id == 3 and got[7].n_links == 2 and not got[7].kept
    near = ivfpq.nearest(df.union(df.where("vec_id in (0, 5, 100)")), k=10).collect()
    for q, want in ((0, 10), (100, 2)):
        own = sorted((r["rank"], r.vec_id) for r in near if r.query_id == q)
        assert [a for a, _ in own] == list(range(1, want + 1)) and len({b for _, b in own}) == want
    d = {i: float(np.linalg.norm(np.array(v) - np.array(wide[0]))) for i, v in enumerate(wide) if i}
    best = sorted(d, key=lambda i: (d[i], i))[:10]
    assert len({r.vec_id for r in near if r.query_id == 0} & set(best)) >= 9


def test_nearest_by_brute_force(spark):
    m = clustered(2, n=3000)
    df, n = vectors(spark, m)
    got: dict = {}
    for r in ivfpq.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, n, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((m.astype(float) - m[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(n), d))[:10]
        assert sorted(found) == list(range(1, 11)) and all(abs(d[v] - s) < 1e-9 for v, s in found.values())
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda x: (x[1], x[0]))
        hits += len({v for v, _ in found.values()} & set(best.tolist()))
    assert hits >= 0.9 * 10 * len(got)
    few, _ = vectors(spark, m[:5])
    assert len(ivfpq.nearest(few).collect()) == 4 and ivfpq.nearest(few.limit(0)).count() == 0


def test_nearest_settles_ties_of_many_copies(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(2600, 16)).astype(np.float32)
    m[rng.permutation(np.arange(1, 2600))[:700]] = m[0]
    m[rng.permutation(np.arange(1, 2600))[:300]] = m[1] + rng.normal(size=(300, 16)).astype(np.float32) * 1e-3
    m[200], m[300] = m[0], m[1]
    df, n = vectors(spark, m, odd=False)
    got: dict = {}
    for r in ivfpq.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in (0, 200, 300):
        d = np.sqrt(((m.astype(float) - m[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        assert [got[q][i] for i in range(1, 11)] == np.lexsort((np.arange(n), d))[:10].tolist()


def test_nearest_finds_k_beside_small_lists(spark, monkeypatch):
    """Far outliers have lists of their own, which hold fewer than k others."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(2400, 8)).astype(np.float32) * 0.01
    m[:, 0] += np.arange(2400) % 4
    far = [100, 101, 102, 700, 701]
    m[far] += np.array([[50] * 8] * 3 + [[-50] * 8] * 2)
    centres = np.array([[c] + [0] * 7 for c in range(4)] + [[50] * 8, [-50] * 8], float)
    fit = ivfpq.fit
    monkeypatch.setattr(ivfpq, "fit", lambda sample, lists: ivfpq.Index(centres, (ix := fit(sample, lists)).parts, ix.books))
    df, _ = vectors(spark, m, odd=False)
    df = df.union(df.where("vec_id = 100"))
    got: dict = {}
    for r in ivfpq.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r["rank"])
    assert len(got) == 24 and all(ranks == set(range(1, 11)) for ranks in got.values())
