import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, embed_dedup, html, packing

VEC = "vec_id long, embedding array<float>, label int, score double, rep long"


def vectors(spark, n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n - 3, 7):
        x[i + 1] = x[i] + rng.standard_normal(dim) * 0.05 * (i % 5)
        x[i + 3] = x[i] + rng.standard_normal(dim) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, [float(v) for v in np.float32(x[i])], None if i % 31 == 0 else i % 3 // 2, 0.0, 5) for i in range(n)]
    odd = [(n, None, 1, 0.0, 5), (n + 1, [0.0] * dim, 1, 0.0, 5), (n + 2, [float("nan")] * dim, 1, 0.0, 5), (n + 3, [None] + [1.0] * (dim - 1), 1, 0.0, 5), (n + 4, [float("inf")] * dim, 1, 0.0, 5), (None, rows[0][1] if rows else None, 1, 0.0, 5)]
    return rows, odd


def usable(rows):
    return [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]


def test_ann_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_A_SHARD", 300)
    monkeypatch.setattr(ann, "QUERIES_A_BLOCK", 20)
    rows, odd = vectors(spark, 1200, 32)
    df = spark.createDataFrame(rows + odd, VEC)
    got = defaultdict(dict)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 20, share=0.3, more=10).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    ok = usable(rows + odd)
    hits = total = 0
    for q, v, _ in ok:
        if q % 20:
            continue
        want = sorted(((-float((v * w).sum()), i) for i, w, _ in ok if i != q))[:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert [got[q][k][1] for k in range(1, 21)] == sorted((s for _, s in got[q].values()), reverse=True)
        hits += len({i for _, i in want} & {i for i, _ in got[q].values()})
        total += 20
        by = {i: w for i, w, _ in ok}
        assert all(math.isclose(s, float((by[i] * v).sum()), rel_tol=1e-12, abs_tol=1e-15) for i, s in got[q].values())
    assert hits / total >= 0.9


def test_ann_small_and_empty(spark):
    rows, odd = vectors(spark, 3)
    df = spark.createDataFrame(rows + odd, VEC)
    assert [(r.query_id, r["rank"]) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect()] == [(0, 1), (0, 2)]
    empty = spark.createDataFrame([], VEC)
    assert ann.search(empty, empty).collect() == []
    tied = spark.createDataFrame([(i, [1.0, 1.0], 0, 0.0, 1) for i in (40, 3, 2, 9)], VEC)
    assert [r.vec_id for r in ann.search(tied, tied.where("vec_id = 40"), 2).orderBy("rank").collect()] == [2, 3]


def test_ann_recall_with_a_hot_group_of_copies():
    """A third of a full shard are copies of one vector; parameters as registered."""
    rng = np.random.default_rng(5)
    n, dim = ann.ROWS_A_SHARD, 32
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[rng.choice(n, n // 3, replace=False)] = x[0]
    pivots = np.hstack([x[rng.choice(n, ann.PIVOTS, replace=False)], np.zeros((ann.PIVOTS, 1))])
    asked = np.vstack([x[0], x[0] + 0.05 * rng.standard_normal((4, dim))])
    frame = lambda ids, v: pd.DataFrame({"vec_id": ids, "embedding": list(v), "perm": list(ann.nearest_pivots(v, np.zeros(len(v)), pivots, ann.PREFIX))})
    rows, queries = frame(np.arange(n), x), frame(np.array([0, n, n + 1, n + 2, n + 3]), asked)
    results = []
    for at in (np.arange(n), rng.permutation(n)):
        got = ann.search_shard(queries, rows.iloc[at], 20, ann.PIVOTS, ann.CANDIDATES, ann.MORE_CANDIDATES)
        results.append({q: list(g["vec_id"]) for q, g in got.groupby("query_id")})
    hits = 0
    for q, v in zip(queries["vec_id"], asked):
        score = (x * v).sum(1)
        want = [i for i in np.lexsort((np.arange(n), -score)) if i != q][:20]
        hits += len(set(want) & set(results[0][q]))
    assert results[0] == results[1] and hits / 100 >= 0.9


def test_ann_recall_as_registered():
    """A full shard of unrelated vectors of 64 dimensions, the hardest case, with the registered parameters."""
    rng = np.random.default_rng(8)
    n, dim = ann.ROWS_A_SHARD, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = np.hstack([x[rng.choice(n, ann.PIVOTS, replace=False)], np.zeros((ann.PIVOTS, 1))])
    perm = ann.nearest_pivots(x, np.zeros(n), pivots, ann.PREFIX)
    rows = pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "perm": list(perm)})
    asked = rows.iloc[:: n // 40]
    got = {q: set(g["vec_id"]) for q, g in ann.search_shard(asked, rows, 20, ann.PIVOTS, ann.CANDIDATES, ann.MORE_CANDIDATES).groupby("query_id")}
    hits = 0
    for q in asked["vec_id"]:
        score = x @ x[q]
        score[q] = -9
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * len(asked)) >= 0.9


def test_ann_copies_and_repeated_rows():
    rows = pd.DataFrame({"vec_id": [5, 5, 1, 9, 9, 9, 3], "embedding": [[1.0, 0.0]] * 6 + [[2.0, -0.0]], "perm": [[0]] * 7})
    asked = lambda q: pd.DataFrame({"vec_id": [q], "embedding": [[1.0, 0.0]], "perm": [[0]]})
    find = lambda q, k: list(ann.search_shard(asked(q), rows, k, 1, 0.1, 1)["vec_id"])
    assert find(5, 3) == [3, 1, 9] and find(9, 6) == [3, 1, 5, 5] and find(7, 4) == [3, 1, 5, 5]
    assert list(ann.search_shard(asked(5), rows.iloc[:2], 3, 1, 0.1, 1)["vec_id"]) == []


@pytest.mark.parametrize("block", [4096, 40])
def test_embedding_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "ROWS_A_BLOCK", block)
    rows, odd = vectors(spark, 400)
    rows += [(1000 + i, rows[5][1], rows[5][2], 0.0, 5) for i in range(30)] + [rows[7]]
    got = sorted(map(repr, (tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows + odd, VEC)).collect())))
    ok = [(k, i, v / np.sqrt((v**2).sum()), lab) for k, (i, v, lab) in enumerate(usable(rows + odd)) if lab is not None]
    up = {i: i for _, i, _, _ in ok}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = Counter()
    for k, i, v, lab in ok:
        for k2, j, w, lab2 in ok:
            if k < k2 and lab == lab2 and (v * w).sum() >= 0.93:
                n[k] += 1
                n[k2] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = [(i, n[k], root(i), i == root(i)) for k, i, _, _ in ok]
    taken = Counter(i for _, i, _, _ in ok)
    for i, *_ in rows + odd:
        if taken[i]:
            taken[i] -= 1
        else:
            want.append((i, 0, i, True))
    assert got == sorted(map(repr, want))


def test_embedding_dedup_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VEC)).collect() == []


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>top</header><nav><ul><li><a href="/a">A</a></li></ul></nav>'
    '<div class="ad">buy</div><article><h1>H &amp; 1</h1><p>a<b>b</b>  c&nbsp;d\n<br>e<p>second</p><p><b>open<br><p>third &lt;x&gt;</p><div class="share-buttons">tweet</div>'
    '<aside>side</aside></article><div id="comments"><article class="comment"><p>nope</p></article></div><footer>&copy; f</footer></body></html>'
)


def text(page):
    return " ".join(html.parse(page)[0])


def test_html_structure():
    assert text(PAGE) == "H & 1 ab c d e second open third <x>"
    assert text(PAGE[: PAGE.index("third") + 3]) == "H & 1 ab c d e second open thi"
    assert text("<div><p>x</p><div class='cookie-banner'>c</div></div>plain") == "x plain"
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    assert text("no markup & <3") == "no markup & <3"
    assert text("<!-- <p>c</p> --><p>1 < 2</p><script>x") == "1 < 2"
    assert text("<p>" + "long " * 50_000) == ("long " * 50_000).strip()
    assert text("<div>" * 3000 + "deep") == "deep"
    assert text("") == "" and text("<nav>n</nav>") == ""


def test_html_marks_are_attributes_of_their_own():
    for page in (
        '<article title="the hidden cost"><p>body</article>', '<article class="post tags-news"><p>body</article>', '<article><section class="search-engines"><p>body</section></article>',
        '<article><p data-id="share">body</article>', '<article><p data-x=\'class="ad"\'>body', '<article class="related"><p>body', '<p alt="role=banner">body', "<p title='a > b'>body", '<p class="has-sidebar">body',
    ):
        assert text(page) == "body", page
    for page in (
        '<div class="site-header menu">x</div>', "<div id=CommentList>x</div>", "<div class='cookie-banner-2'>x", '<p hidden>x</p>', '<p style="color:red; display : none">x</p>', "<div role=navigation>x</div>",
        '<div class="comments"><article class="comment"><p>x</article></div>', '<article class="comment-body"><p>x</article>', "<div aria-hidden='true'>x</div>",
    ):
        assert text(page + "<p>body</p>" if page.endswith(">") else page + "</div><p>body") == "body", page
    assert text('<p>a <span class="ad">x <span>y</span> z</span> b') == "a b"
    assert text('<form action="/"><div><main><p>m</p></main></div><p>f</p></form>') == "m"
    assert text("<ul><li><p>a<li><p>b</ul><dl><dt>c<dd>d</dl>") == "a b c d"


def test_html_long_and_broken_pages_take_linear_time():
    import time

    began = time.process_time()
    for page in ('<a "' * 40_000, "<a x='" * 40_000, "<div>x" * 20_000, "<div>x" * 20_000 + "</p></span>" * 20_000, "<p>x</div>" * 20_000, "<" * 200_000, "<!" * 100_000, "<b class=ad>" * 20_000 + "</b>" * 20_000, "<a  " * 40_000):
        texts, nodes, hashes, parents = html.parse(page)
        assert len(texts) == len(nodes) and len(hashes) == len(parents) <= page.count("<div>")
    assert time.process_time() - began < 20


def test_html_row_numbers_survive_another_file_split(spark):
    rows = [(i, f"http://h.example/{i}", f"<div><p>story {i}</p></div>" + (f"<div><p>follow {i % 3}</p></div>" if i % 2 else "")) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    out = html.extract(df)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 30))
    try:
        got = {r.page_id: r.text for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"story {i}" for i in range(120)}


def test_html_templates_match_brute_force(spark):
    """Every subtree counted by distinct pages in plain Python; extra columns, repeated rows and nulls included."""
    r = random.Random(4)
    bits = ["<div><p>one</p></div>", "<section>two<div>three</div></section>", "<ul><li>four</ul>", "<div>five"]
    rows = []
    for i in range(150):
        body = "".join(r.choice(bits) if r.random() < 0.6 else f"<p>own {r.randint(0, 400)}</p>" for _ in range(r.randint(0, 6)))
        rows.append((i, r.choice(["http://a.example/x", "http://b.example/y", None, ""]), body if i % 10 else None, "t"))
    rows += [rows[3], rows[3], (None, "http://a.example/x", rows[4][2], "t")]
    host = lambda u: (u or "").split("/")[2] if "//" in (u or "") else ""
    pages = defaultdict(set)
    parsed = [html.parse(h or "") for _, _, h, _ in rows]
    for (_, u, _, _), (texts, _, hashes, _) in zip(rows, parsed):
        for h in hashes:
            pages[host(u), h].add(" ".join(texts))
    want = []
    for (i, u, _, _), (texts, nodes, hashes, parents) in zip(rows, parsed):
        kept = []
        for t, k in zip(texts, nodes):
            while k >= 0 and len(pages[host(u), hashes[k]]) < 5:
                k = parents[k]
            if k < 0:
                kept.append(t)
        want.append((i, u, " ".join(kept)))
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and any(len(x) >= 5 for x in pages.values())


def test_html_templates(spark):
    body = lambda i: f"<div><p>story {i}</p></div><div><p>Follow us</p> on every page</div>"
    rows = [(i, f"http://h.example/{i}", body(i)) for i in range(8)] + [(8, "http://other.example/1", body(8)), (9, None, None), (None, "x", ""), (10, "http://h.example/x", PAGE)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3" and got[8] == "story 8 Follow us on every page" and got[9] == "" and got[None] == "" and got[10] == text(PAGE)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []


def test_html_quoted_passage_stays(spark):
    rows = [(i, "http://h.example/", f"<article><p>same passage</p><p>own {i}</p></article>") for i in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"same passage own {i}" for i in range(9)}


def test_html_copies_keep_their_text(spark):
    """Copies of a page, under one URL or several, are one page: what they share is no template."""
    box = "<div><p>Follow us</p> everywhere</div>"
    page = lambda i: f"<div><section><p>story {i}</p><table><tr><td>cell {i}</td></tr></table></section></div>{box}"
    urls = ["http://h.example/a", "http://h.example/a", "http://h.example/a#top", "http://h.example/a?utm_source=x", "http://h.example/a.html"]
    rows = [(k, u, page(0)) for k, u in enumerate(urls * 4)] + [(100 + i, f"http://h.example/{i}", page(i)) for i in range(1, 9)]
    rows += [(200 + k, f"http://copies.example/{k}", page(0)) for k in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "story 0 cell 0" for k in range(20)) and all(got[100 + i] == f"story {i} cell {i}" for i in range(1, 9))
    assert all(got[200 + k] == "story 0 cell 0 Follow us everywhere" for k in range(9))


@pytest.mark.parametrize("size", [20, 1500])
def test_html_templates_whatever_the_host_size(spark, size):
    """A subtree on 5 pages goes from a small and a large host alike, one on 4 stays on both."""
    box = lambda i: f"<div><p>{'winter' if i < 5 else 'summer'} campaign</p></div>" if i < 9 else ""
    rows = [(i, f"http://h.example/{i}", f"<article><p>story {i}</p><p>quoted</p>{box(i)}</article>") for i in range(size)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i} quoted" + " summer campaign" * (5 <= i < 9) for i in range(size)}


def plain_fit(items, capacity, limit):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and b["left"] > 0 and cluster not in b["clusters"] and b["sources"][source] < limit]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append({"left": capacity, "clusters": set(), "sources": Counter()})
        out.append((b, capacity - bins[b]["left"]))
        bins[b]["left"] -= size
        bins[b]["clusters"].add(cluster)
        bins[b]["sources"][source] += 1
    return out


def test_fit_is_best_fit():
    r = random.Random(3)
    for limit in (1, 2, 4):
        for _ in range(60):
            items = sorted(((r.randint(1, 60), r.randint(0, 2), r.randint(0, 12)) for _ in range(80)), reverse=True)
            assert packing.fit(items, 60, limit) == plain_fit(items, 60, limit)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_GROUP", 50)
    r = random.Random(1)
    rows = [(i, "w " * r.randint(0, 90), "hot" if i % 3 else None, 1) for i in range(200)] + [(None, None, "s", 1), (7, "x " * 250, "s", 1), (7, "x " * 250, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    got = packing.pack(df, capacity=100).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, packing.pack(df, capacity=100).collect()), key=repr)
    assert sorted(map(repr, got)) == sorted(map(repr, packing.pack(df.repartition(5), capacity=100).collect()))
    fill, used = Counter(), defaultdict(list)
    for x in got:
        if x.bin_id is not None:
            fill[x.bin_id] += x["size"]
            used[x.bin_id].append((x.offset, x["size"]))
    assert max(fill.values()) <= 100 and len(fill) < 1.5 * sum(fill.values()) / 100
    assert all(a + n == b for u in used.values() for (a, n), (b, _) in zip(sorted(u), sorted(u)[1:]))
    per = Counter()
    for x in got:
        per[x.doc_id] += x["size"]
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len((t or "").split())
    assert per == want
    assert packing.pack(df.limit(0)).collect() == []


def test_groups_match_brute_force(spark, monkeypatch):
    """Every group's bins by looking at every bin, over nulls, copies, long texts and repeated rows."""
    monkeypatch.setattr(packing, "ROWS_A_GROUP", 40)
    r = random.Random(12)
    rows = [(i, "w " * r.choice([0, 3, 17, 17, 40, 99, 250]) + r.choice(["", "x", "y", f"z{i}"]), r.choice(["a", "b", None])) for i in range(150)]
    rows += [(None, "n " * 30, "a"), (5, None, "b"), rows[9], rows[9], rows[11]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = F.xxhash64(F.coalesce("text", F.lit("")))
    groups = -(-len(rows) // 40)
    many = df.select("doc_id", "source", m.alias("m"), F.coalesce(F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))), F.lit(0)).alias("size")).groupBy("doc_id", "source", "m", "size").count()
    each = many.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("row")).withColumn("group", F.pmod(F.xxhash64("doc_id", "m", "row"), F.lit(groups))).collect()
    want = Counter()
    for g in range(groups):
        last = lambda x: (x is None, x if x is not None else 0)
        items = sorted((x for x in each if x.group == g), key=lambda x: (-(x["size"] % 100), last(x.doc_id), (x.source is None, x.source or ""), x.m, x["size"]))
        rest = [x for x in items if x["size"] % 100]
        bins = defaultdict(list)
        for x, (b, offset) in zip(rest, plain_fit([(x["size"] % 100, x.source, x.m) for x in rest], 100, packing.SOURCE_LIMIT)):
            bins[b].append((x.doc_id, x["size"] // 100, x["size"] % 100, offset))
        for b in bins.values():
            want[frozenset(Counter(b).items())] += 1
        for x in items:
            for piece in range(x["size"] // 100):
                want[frozenset({((x.doc_id, piece, 100, 0), 1)})] += 1
    got = defaultdict(list)
    for x in packing.pack(df, capacity=100).collect():
        if x.bin_id is not None:
            got[x.bin_id].append((x.doc_id, x.piece, x["size"], x.offset))
    assert Counter(frozenset(Counter(b).items()) for b in got.values()) == want


def test_query_set_is_only_a_filter(spark):
    assert spark.range(41).where(F.col("id") % 20 == 0).count() == 3
