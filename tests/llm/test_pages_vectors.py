"""Operators over pages and embeddings, and the pipeline, against brute force and round trips."""

import base64
import hashlib
import math
import os
import random
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.llm import components, embeddings, html_tree, topk, warc

PAGE = "page_id long, url string, html string, ok int, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    big = "".join(rng.choices("abc <>é✓\r\n", k=60_000))
    htmls = ["<p>a</p>", "<p>a</p>", None, "", big, big, big + "x", "é" * 20_000, "<p>b</p>"]
    rows = [(i, f"http://x.example/{i}?q=ü y", h, 1, "d") for i, h in enumerate(htmls)]
    rows += [rows[0], (None, None, "<p>a</p>", 1, "d")]
    return spark.createDataFrame(rows, PAGE), rows


def test_warc_round_trip(spark, pages):
    df, rows = pages
    out = warc.round_trip(df, segment=1000, keep_payload=True).collect()
    assert len(out) == len(rows) and all(r["ok"] for r in out)
    first, by_id = {}, {}
    for i, _, h, *_ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
            by_id[i] = (h or "").encode()
    for r in out:
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        body = by_id[r["page_id"]]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if first[body.decode()] == r["page_id"]:
            assert r["record_type"] == "response" and r["refers_to"] is None and r["payload"] == body
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first[body.decode()]


def test_warc_keeps_urls_of_any_script(spark):
    urls = ["http://x.example/straße?q=ü", "http://例え.example/路", "http://x.example/a b\r\nX: y", "http://x.example/%C3%BC#z", " ", None]
    rows = [(i, u, f"<p>{i}</p>", 1, "d") for i, u in enumerate(urls)]
    out = {r["page_id"]: r["url"] for r in warc.round_trip(spark.createDataFrame(rows, PAGE)).collect()}
    assert [unquote(out[i]) for i in range(3)] == urls[:3] and all(c.isascii() and c > " " for i in range(4) for c in out[i])
    assert out[3] == urls[3] and out[4] == out[5] == "urn:none"


def test_warc_threshold_and_empty(spark, pages):
    df, _ = pages
    kinds = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, min_revisit=1000).collect()}
    assert kinds[1] == "response" and kinds[3] == "response" and kinds[5] == "revisit"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reports_missing_segments(spark):
    recs = list(warc.page_records("urn:page:0:0:7", 7, "http://x.example/", b"0123456789" * 500, None, segment=1000))
    import zlib

    def archive(parts):
        return b"".join((c := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(p) + c.flush() for p in parts)

    for kept, ok in ((recs[::-1], True), (recs[:2] + recs[3:], False), (recs[:-1], False), (recs[1:], False)):
        parsed = list(warc.parse_archive(archive(kept)))
        rows = [((h.get("warc-segment-origin-id") or h["warc-record-id"]).strip("<>"), int(h["x-page-id"]) if "x-page-id" in h else None, h.get("warc-target-uri"), h["warc-type"], None, h.get("warc-payload-digest", "sha1:").removeprefix("sha1:") or None, int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, bytearray(b)) for h, b in parsed]
        got = warc.decode(warc.reassemble(spark.createDataFrame(rows, warc.FIELDS))).collect()
        assert len(got) == 1 and got[0]["ok"] is ok and (got[0]["payload"] == b"0123456789" * 500) is ok


def test_chunked_framing():
    rng = random.Random(1)
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        body = rng.randbytes(n)
        assert warc.dechunked(warc.chunked(body)) == body
    assert warc.dechunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def brute_marginals(model, nodes):
    """Sum over all labellings."""
    n, own = len(nodes), model.own(nodes)
    total, on = 0.0, [0.0] * n
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        e = sum(sum(model.weights.get(f, 0.0) for f in own[i]) for i in range(n) if y[i])
        e += sum(model.tables[html_tree.kind(nodes[i])][y[nodes[i][0]]][y[i]] for i in range(1, n))
        w = math.exp(e)
        total += w
        for i in range(n):
            on[i] += w * y[i]
    return [x / total for x in on]


def test_sum_product_is_exact():
    rng = random.Random(8)
    nodes = html_tree.Tree("<div class=ad><p>a</p><p>bb <a href=1>c</a></p></div><article><h1>T</h1><p>long text here</p></article>").nodes
    names = {f for fs in html_tree.Model({}, {}).own(nodes) for f in fs}
    model = html_tree.Model({f: rng.uniform(-2, 2) for f in names}, {k: tuple(tuple(rng.uniform(-2, 2) for _ in range(2)) for _ in range(2)) for k in ("text", "turn", "open", "plain")})
    assert np.allclose(model.marginals(nodes), brute_marginals(model, nodes))


def test_html_main_text(spark):
    head = "<html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class=ad>Buy this</div>"
    page = head + "<article><h1>A &amp; B</h1><p><b>First   paragraph of\nit<br><p>Second &#233;&nbsp;one, <i>in</i>line.</p></article><aside><p>Side words</p></aside><footer>&copy; 2020 foot</footer>"
    rows = [(1, "u", page, 1, "d"), (2, None, None, 1, "d"), (3, "u", "", 1, "d"), (4, "u", head + "</body>", 1, "d"), (5, "u", "<div>" * 30_000 + "x" + "</div>" * 30_000, 1, "d"), (None, "u", page, 1, "d"), (1, "u", page, 1, "d")]
    df = spark.createDataFrame(rows, PAGE)
    model = html_tree.fit(df)
    out = {(r["page_id"], i): r for i, r in enumerate(html_tree.extract(df, model).collect())}
    want = "A & B First paragraph of it Second é one, inline."
    texts = [r["text"] for r in out.values()]
    assert texts.count(want) == 3 and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert all(r["text"] == "" for r in out.values() if r["page_id"] in (2, 3, 4))
    assert html_tree.extract(df.limit(0), html_tree.fit(df.limit(0))).count() == 0


def test_html_hand_labelled_pages_are_learned(spark):
    model = html_tree.fit(spark.createDataFrame([], PAGE))
    for page in html_tree.LABELLED:
        nodes = html_tree.Tree(page.replace("{p}", html_tree._P).replace("{q}", html_tree._Q), marks=True).nodes
        for x, p in zip(nodes, model.marginals(nodes)):
            if x[5]:
                assert (p >= 0.5) == bool(x[6]), (page[:60], x[5][:30])


def vectors():
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(6):
            c = rng.standard_normal(16)
            for _ in range(5):
                rows.append((k, (c + rng.standard_normal(16) * 0.05 * np.linalg.norm(c) / 4).astype(float).tolist(), label))
                k += 1
    v = rows[0][1]
    rows += [(k, v, 0), (k + 1, [2 * x for x in v], 0), (k + 2, v, 1), (k + 3, v, None), (k + 4, None, 0), (k + 5, [0.0] * 16, 0), (k + 6, [float("nan")] + v[1:], 0), (k + 7, [None] + v[1:], 0), (k + 8, [float("inf")] + v[1:], 0), (k + 9, v[:8], 0), (k + 10, [], 0), rows[0]]
    return rows


VEC = "vec_id long, embedding array<double>, label int"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_embedding_links(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VEC).withColumns({c: F.lit(1) for c in ("rep", "code", "block", "n_links")})
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    rows = list({r[0]: r for r in rows}.values())
    links = {i: set() for i, *_ in rows}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] is not None and a[2] == b[2] and sound(a[1]) and sound(b[1]) and len(a[1]) == len(b[1]) and any(a[1]) and any(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    comp = {i: i for i in links}
    for _ in links:
        for i in links:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    assert set(out) == set(links)
    for i, r in out.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[i]), comp[i], comp[i] == i), i
    assert embeddings.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_large_buckets_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(1)
    c = rng.standard_normal(8)
    rows = [(i, (c + 0.01 * rng.standard_normal(8)).tolist(), 1) for i in range(70)]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, VEC)).collect()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T) >= 0.98).sum(axis=1) - 1
    assert [r["n_links"] for r in sorted(out)] == want.tolist() and {r["component_id"] for r in out} == {0}


def test_top_k_is_exact(spark):
    rows = [r for r in vectors() if r[1] != []] + [(500 + i, [0.1, 0.2], None) for i in range(4)] + [(None, [1.0], 1)]
    df = spark.createDataFrame(rows, VEC).withColumns({"vec": F.lit(1), "dist": F.lit(1), "rank": F.lit(1)})
    out = {}
    for r in topk.top_inner(df, F.col("vec_id") % 10 == 0, pivots=4).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = {r[0]: [math.floor(256 * x) for x in r[1]] for r in rows if r[0] is not None and sound(r[1])}
    want = {}
    for i in q:
        if i % 10 == 0:
            s = sorted(((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i))[:5]
            want[i] = [(k, j, -v) for k, (v, j) in enumerate(s, 1)]
    assert {i: sorted(v) for i, v in out.items()} == want
    assert topk.top_inner(spark.createDataFrame([], VEC), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_many_blocks_is_exact(spark, monkeypatch):
    """Blocks that bounds leave out, ties across blocks, several vectors of one vec_id."""
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(12)
    middles = rng.standard_normal((6, 8)) * 9
    x = np.round(middles[rng.integers(0, 6, 900)] + rng.standard_normal((900, 8)), 2)
    x[300:330] = x[299]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    other = [(5, (x[5] * 3).tolist(), 0), (300, (x[299] * 5).tolist(), 0)]
    out = {}
    for r in topk.top_inner(spark.createDataFrame(rows + other, VEC), F.col("vec_id") % 50 == 0).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v, _ in rows}
    for i, v, _ in other:
        q[i] = np.array(min(q[i].tolist(), np.floor(256 * np.array(v)).astype(np.int64).tolist()))
    for i in range(0, 900, 50):
        want = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        assert sorted(out[i]) == [(k, j, -s) for k, (s, j) in enumerate(want, 1)], i


def test_embeddings_of_any_magnitude(spark):
    rng = np.random.default_rng(13)
    c = rng.standard_normal(8)
    near = [c + 0.02 * rng.standard_normal(8) for _ in range(6)]
    scale = (1.0, 1e200, 1e-200, 1e300, 1e-300, 3.0)
    rows = [(i, (v * s).tolist(), 1) for i, (v, s) in enumerate(zip(near, scale))] + [(9, (-c * 1e250).tolist(), 1)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    assert out == {**{i: (5, 0) for i in range(6)}, 9: (0, 9)}


def test_embedding_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest to meet, against brute force; several hyperplanes a table."""
    rng = np.random.default_rng(14)
    rows, d = [], 32
    for i in range(600):
        a = rng.standard_normal(d)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(d)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cos = rng.uniform(0.975, 0.985)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (cos * a + math.sqrt(1 - cos * cos) * b).tolist(), 0)]
    out = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T) >= 0.98).sum(axis=1) - 1
    got = np.array([out[i] for i in range(len(rows))])
    assert (got <= want).all() and want.sum() > 400 and got.sum() >= 0.999 * want.sum()


def test_pivot_bounds_stop_early():
    rng = np.random.default_rng(0)
    c = np.floor(rng.standard_normal((4000, 8)) * 300)
    piv = c[:16]
    dist = lambda x: np.sqrt(((x[:, None, :] - piv[None]) ** 2).sum(2))
    got = list(topk.best_in_block(np.array([1]), c[:1] * 3, dist(c[:1] * 3), np.arange(10, 4010), c, dist(c), 5))
    s = c @ (c[0] * 3)
    assert got[0][1].tolist() == (np.lexsort((np.arange(4000), -s))[:5] + 10).tolist()


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 5), (7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in parent}


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it has to do, on a small corpus with a junk text, near copies and a shared passage."""
    import corpus_pipeline

    from .test_documents import DOC, labelled, sentence

    docs, labels = labelled(spark, 120)
    rng = random.Random(7)
    good = [r["text"] for r in docs.collect() if r["doc_id"] in (1, 2, 3)]
    passage = sentence(rng, 70)
    extra = [(1000, good[0], "en", "s", 1), (1001, f"{good[1]} {passage} {good[2]}", "en", "s", 1), (1002, f"{good[2]} {passage}", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, DOC))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    sf, names = f"file://{tmp_path}", [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "target_mixture", "best_fit_packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs)
    assert 0 < seen[0].count() < 126 and 1000 not in {r[0] for r in seen[1].select("doc_id").collect()}
    assert sum(passage in (r["text"] or "") for r in seen[2].collect()) <= sum(passage in (r["text"] or "") for r in seen[1].collect()) - 1
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {"doc_id", "bin_id", "bin_capacity"} <= set(out.columns) and out.count() >= docs.count()


def test_malformed_pages_keep_their_text():
    read = lambda page: [x[5] for x in html_tree.Tree(page).nodes if x[5]]
    for odd in ("<![1]>", "<![foo[x]>", "<![>", "<![if !IE]>"):
        assert read(f"<body><p>one</p>{odd}<p>two</p></body>") == ["one", "two"], odd
    assert read("<head><title>t</title><meta charset=utf-8><p>one</p><p>two</p>") == ["one", "two"]
    assert read("<head><title>t</title><noscript><img src=x></noscript><style>s</style></head><p>one</p>") == ["one"]
    for tag in ("object", "video", "svg", "noscript"):
        assert read(f"<body><div><p>one</p><{tag}><div>in</div></div><p>two</p></body>") == ["one", "in", "two"], tag
        assert read(f"<body><div><{tag}><p>in</p></{tag}><p>one</p></div></body>") == ["one"], tag


def test_unclosed_dropped_elements_take_nothing_along():
    read = lambda page: [x[5] for x in html_tree.Tree(page).nodes if x[5]]
    for tag in ("object", "video", "svg", "noscript", "iframe", "canvas"):
        assert read(f"<body><{tag}><p>one</p><p>two</p>") == ["one", "two"], tag
        assert read(f"<body><{tag}><p>in</p></{tag.upper()} ><p>one</p>") == ["one"], tag
    assert read("<p>one</p><!-- never closed <p>two</p>")[:1] == ["one"]
    assert read("<p>one</p><script>never closed <p>two</p>") == ["one"]


def test_text_after_unclosed_elements_of_an_article_stays():
    read = lambda page: [x[5] for x in html_tree.Tree(page).nodes if x[5]]
    tags = "svg object iframe video template noscript canvas audio".split()
    for tag in tags:
        assert read(f"<body><article><p>a</p><{tag}><p>MIDDLE</p></article><p>z</p></body>") == ["a", "MIDDLE", "z"], tag
        assert read(f"<article><p>a</p><{tag}><p>x</p></{tag}><p>b</p></article>") == ["a", "b"], tag
        assert read(f"<article><p>a</p><{tag}><{tag}><p>x</p></{tag}><p>b</p></article><p>z</p>") == ["a", "b", "z"], tag  # one of two has no end
        assert read(f"<article><{tag}><p>a</p><svg><path></svg><script>var x;</script><p>b</p></article>") == ["a", "b"], tag
    for a in tags:
        for b in tags:
            if a != b:
                assert read(f"<article><p>a</p><{a}><p>b</p><{b}><p>c</p><{a}>d</article><p>z</p>") == ["a", "b", "c", "d", "z"], (a, b)
                assert read(f"<article><p>a</p><{a}><p>b</p><{b}><p>c</p></{b}>d</article><p>z</p>") == ["a", "b", "d", "z"], (a, b)
    assert read("<article><p>a</p><script/>var x=1;</script><p>b</p><style/>p{a:b}</style><p>c</p><svg/><p>d</p></article>") == ["a", "b", "c", "d"]


def test_odd_attributes_are_data(spark):
    odd = ['<p data-y="12.5">one</p>', "<p data-y>one</p>", '<p data-y="" class id role=>one</p>', '<p data-y=1>one</p><nav data-y="1"><a href=1>Menu</a></nav>']
    want = [x[6] for page in odd for x in html_tree.Tree(page).nodes]
    assert set(want) == {None}
    df = spark.createDataFrame([(i, "u", f"<body><article>{h}</article></body>", 1, "d") for i, h in enumerate(odd)], PAGE)
    out = html_tree.extract(df, html_tree.fit(df)).collect()
    assert [r["text"] for r in sorted(out)] == ["one"] * 4


def test_long_broken_pages_take_linear_time():
    import time

    n = 60_000
    start = time.time()
    for page in ("<center>" * n, "<p><button>" + "<center>" * n, "<svg>" * n + "</svg>" * n, "<div>" * n + "</p>" * n, "<!--" * n, "<ul>" + "<li><b>" * n, "<object><div>" * n + "</div>" * n + "</object>"):
        html_tree.Tree(page + "<p>end</p>")
    assert time.time() - start < 30


def gz(data):
    import zlib

    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def test_warc_reads_on_after_broken_stretches():
    rng = random.Random(5)
    recs = [b"".join(warc.page_records(f"urn:{i}", i, "http://x.example/", rng.randbytes(3000), None)) for i in range(200)]
    members = [gz(r) for r in recs]
    whole = b"".join(members)
    ids = lambda found: [int(h["x-page-id"]) for h, _ in found if warc.BROKEN not in h]
    assert ids(warc.parse_archive(whole)) == list(range(200))
    at = sum(map(len, members[:100])) + len(members[100]) // 2
    flipped = bytearray(whole)
    flipped[at] ^= 0xFF
    found = list(warc.parse_archive(bytes(flipped)))
    broken = [h for h, _ in found if warc.BROKEN in h]
    assert ids(found) == [i for i in range(200) if i != 100] and len(broken) == 1 and broken[0]["x-page-id"] == "100"
    # a header overwritten, bytes between members, and an archive cut short
    assert ids(warc.parse_archive(whole[: len(members[0])] + b"xxxx" + whole[len(members[0]) + 4 :])) == [0, *range(2, 200)]
    found = list(warc.parse_archive(whole[: len(members[0])] + b"junk" + whole[len(members[0]) :]))
    assert ids(found) == list(range(200)) and sum(warc.BROKEN in h for h, _ in found) == 1
    found = list(warc.parse_archive(whole[:-20]))
    assert ids(found) == list(range(199)) and warc.BROKEN in found[-1][0]


def test_warc_reads_foreign_archives(spark, tmp_path):
    recs = [b"".join(warc.page_records(f"urn:{i}", i, "http://x.example/", b"body %d" % i, None)) for i in range(5)]
    info = warc.record("warcinfo", "urn:info", [("Content-Type", "application/warc-fields")], b"software: x\r\n")
    bare = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:bare>\r\nWARC-Payload-Digest: md5:00\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\n\r\nplain body!\r\n\r\n"
    odd = b"WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: \xff12\r\nContent-Length: many\r\n\r\nblock\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gz(b"".join(recs)))  # five records in one member
    (tmp_path / "b.warc").write_bytes(info + bare + odd + recs[0])  # not compressed
    out = warc.decode(warc.reassemble(warc.read_records(spark, f"file://{tmp_path}"))).collect()
    assert sorted(r["page_id"] for r in out if r["page_id"] is not None) == [0, 0, 1, 2, 3, 4]
    assert all(r["payload"] == b"body %d" % r["page_id"] for r in out if r["page_id"] is not None)
    assert sum(not r["ok"] for r in out) >= 1 and any(r["payload"] == b"plain body!" for r in out)
    for body in (b"-5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(body)


def test_warc_takes_linear_time():
    import time

    def took(n):
        rng = random.Random(1)
        data = b"".join(gz(b"".join(warc.page_records(f"urn:{i}", i, "u", rng.randbytes(2000), None))) for i in range(n))
        start = time.time()
        assert sum(1 for _ in warc.parse_archive(data)) == n
        return time.time() - start

    took(500)
    assert took(8000) < 2 + 8 * took(2000)


def test_warc_attempts_leave_one_record(spark, pages, tmp_path):
    """Files of an attempt that wasn't committed are neither read nor left."""
    df, rows = pages
    path = f"file://{tmp_path}/w"
    (tmp_path / "w" / "_attempts").mkdir(parents=True)
    (tmp_path / "w" / "_attempts" / "part-000000-999999-00000.warc.gz").write_bytes(gz(b"".join(warc.page_records("urn:x", 1, "u", b"again", None))))
    warc.write_archives(df, path)
    assert warc.decode(warc.reassemble(warc.read_records(spark, path))).count() == len(rows)
    assert not (tmp_path / "w" / "_attempts").exists()


@pytest.mark.skipif(not os.environ.get("ALL_QUERIES"), reason="takes some minutes; ALL_QUERIES=1 runs it")
def test_pipeline_against_brute_force(spark, tmp_path):
    """Rows of every stage: rules by hand, all pairs, all runs of 50 words, rates by their conditions, words of all bins."""
    import collections

    import corpus_pipeline
    from fleetspan.llm import mixing, quality

    from .test_documents import DOC, covered_brute, jaccard_brute, labelled, naive_stats, sentence, words

    docs, labels = labelled(spark, 100)
    rng = random.Random(17)
    good = [r["text"] for r in docs.collect() if r["doc_id"] in (1, 2, 3)]
    passage = " ".join(good[2].split()[:4]) + " " + sentence(rng, 60)
    prose = lambda n: " ".join(rng.choice("the of and with river stone light water under house green over small which from".split()) for _ in range(n))
    extra = [(500, good[0], "en", "s", 1), (501, good[0] + " more", "en", "s", 1), (502, f"{prose(90)} {passage} {prose(60)}", "en", "s", 1), (503, f"{prose(80)} {passage} {prose(70)}", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, DOC))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    sf, stages = f"file://{tmp_path}", dict(corpus_pipeline.STAGES)
    step = lambda name, x: corpus_pipeline.stored(stages[name](spark, x, sf), name)
    tuples = lambda x: [tuple(r) for r in x.collect()]

    start = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(start, labels)

    def accepted(text):
        stats = dict(zip(quality.STATS, naive_stats(text)))
        z = model.intercept + sum(w * all((stats[n] > t) == above for n, above, t in rule.terms) for rule, w in model.weights)
        return 1 / (1 + math.exp(-z)) >= quality.THRESHOLD

    one = step("quality_classifier", start)
    assert collections.Counter(tuples(one)) == collections.Counter(r for r in tuples(start) if accepted(r[1]))
    two = step("ngram_jaccard_join", one)
    links = jaccard_brute(tuples(one))
    assert collections.Counter(tuples(two)) == collections.Counter(r for r in tuples(one) if r[0] is None or links[r[0]] == r[0])
    three = step("substring_dedup", two)
    before, after = {r[0]: words(r[1]) for r in tuples(two)}, {r[0]: words(r[1]) for r in tuples(three)}
    gone = covered_brute(tuples(two))
    assert set(before) == set(after) and any(any(m) for m in gone.values())
    for i, w in before.items():
        kept = iter(w)
        assert all(x in kept for x in after[i]), i  # what is left keeps its order
        assert len(after[i]) <= len(w) - sum(gone.get(i, ())) and (i in (502, 503) or after[i] == w or any(gone.get(i, ())))
    four = step("target_mixture", three)
    copies = collections.Counter()
    for r in mixing.rates(three, labels, keep="clean").collect():
        copies[r["doc_id"]] += r["copies"]
    assert collections.Counter(r[0] for r in tuples(four)) == +copies
    out = stages["best_fit_packing"](spark, four, sf).collect()
    assert sum(r["n_tokens"] for r in out) == sum(len(words(r[1])) for r in tuples(four))
    bins = collections.defaultdict(list)
    for r in out:
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append((r["bin_offset"], r["n_tokens"], r["bin_capacity"]))
    assert all(sum(n for _, n, _ in b) <= b[0][2] for b in bins.values())
