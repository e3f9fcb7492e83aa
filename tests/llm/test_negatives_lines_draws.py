"""Hard negatives, line dedup and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.llm import importance, line_dedup, negatives

VEC = "vec_id long, label long, embedding array<double>"
DOC = "doc_id long, text string"


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, is_anchor, positives=5, k=10, low=30, high=90):
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    out = set()
    for a, (label, q) in whole.items():
        if not is_anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in whole.items() if i != a}
        score = {i: max(-(2**63), min(2**63 - 1, s)) for i, s in score.items()}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][:positives]:
            fit = [i for i in order if whole[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]][:k]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit)}
    return out


def mined(df, every=10):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    out = [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % every == 0).select(*cols).collect()]
    assert len(out) == len(set(out))
    return set(out)


def clustered(n, seed, labels=4, d=6, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, d))
    return [(i, int(rng.integers(labels)), (centres[i % 5] + spread * rng.standard_normal(d)).tolist()) for i in range(n)]


def test_hard_negatives_match_brute_force_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rows = clustered(300, 1, labels=2) + [(i, i % 9 + 10, v) for i, _, v in [(400 + j, 0, [0.1 * j, 1.0, 0.0, 0.0, 0.0, 0.0]) for j in range(40)]]
    rows += [(1000 + i, 0, [0.5] * 6) for i in range(60)] + [(2000 + i, 1, [0.4] * 6) for i in range(60)]  # copies and ties
    assert mined(spark.createDataFrame(rows, VEC)) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_odd_rows(spark):
    rows = clustered(60, 2)
    rows += [(200, 1, [-x for x in rows[1][2]]), (210, 77, [1.0] * 6), (220, 78, [0.0] * 6), (230, 78, [0.0] * 6), (240, 1, []), (250, 2, [3.0])]
    nan, inf = float("nan"), float("inf")
    odd = [(300, None, [1.0] * 6), (310, 1, None), (320, 1, [nan] * 6), (330, 2, [1.0, None]), (340, 2, [inf] * 6), (350, 2, [1e307] * 6), (None, 1, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd + rows[:10], VEC).withColumns({c: F.lit(1) for c in ("vec", "anchor", "cand", "score", "rank", "q", "b", "g")})
    assert mined(df) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark.createDataFrame([], VEC)) == set()
    assert mined(spark.createDataFrame([(1, 1, [1.0])], VEC)) == set()  # no anchor
    assert mined(spark.createDataFrame([(10, 1, [1.0]), (20, 2, [1.0])], VEC)) == set()  # no positive
    # of rows that share a vec_id the least vector counts
    twice = [(10, 1, [1.0]), (11, 1, [2.0]), (11, 1, [9.0]), (12, 2, [1.0])]
    assert mined(spark.createDataFrame(twice, VEC)) == brute_negatives([twice[0], twice[1], twice[3]], lambda i: i == 10)


def test_hard_negatives_of_any_magnitude(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 5, 12, 17]) for _ in range(3)]) for i in range(40)] + [(50, 0, [1e150, 0.0, 0.0]), (51, 1, [-1e150, 1e100, 0.0])]
    assert mined(spark.createDataFrame(rows, VEC)) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_bounds_of_the_tree_hold_and_spare_work():
    rng = np.random.default_rng(4)
    base = np.floor(256 * rng.standard_normal((8, 16)))
    q = np.concatenate([base + rng.integers(-2, 3, base.shape) for _ in range(20)])
    c = np.floor(256 * rng.standard_normal((2000, 16)))
    exact = q @ c.T
    order, parent, edge = negatives.spanning_tree(q)
    assert sorted(order) == list(range(len(q))) and (parent < 0).sum() == 1
    at = {int(i): n for n, i in enumerate(order)}
    for i, p in enumerate(parent):
        if p >= 0:
            assert at[int(p)] < at[i] and math.isclose(edge[i], np.linalg.norm(q[i] - q[p]))
    # total length of the tree against Kruskal's
    pairs = sorted((np.linalg.norm(q[i] - q[j]), i, j) for i in range(len(q)) for j in range(i))
    root = list(range(len(q)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = 0.0
    for d, i, j in pairs:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert math.isclose(edge.sum(), total)
    spans = [(float(np.sort(x)[-20]), math.inf) for x in exact]
    rescored = 0
    for i, some, score in negatives.walk(q, c, lambda i: (np.ones(len(c), bool), [spans[i]])):
        assert (score == exact[i][some]).all()
        assert set(np.flatnonzero(exact[i] >= spans[i][0])) <= set(some)
        rescored += len(some)
    assert rescored < exact.size / 3


# ---------------------------------------------------------------- line dedup


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [doc is not None and len(k := key(x)) >= min_chars and len(held[k]) >= min_docs and doc != max(held[k]) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc, len(lines), sum(gone), kept))
    return out


def by_none(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def check_lines(df, rows, **how):
    want = brute_lines(rows, **how)
    assert by_none(map(tuple, line_dedup.dedup_lines(df, **how).collect())) == by_none(want)
    assert by_none(map(tuple, line_dedup.digests(df, **how).collect())) == by_none((*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want)


def line_rows(seed, n=60):
    rng = random.Random(seed)
    common = ["All rights reserved by the owners of this page " + str(i) for i in range(6)] + ["Ä" * 40, "ü" * 39, "x" * 40, "x" * 39]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) for _ in range(rng.randrange(6))] + [f"a line that only document {i} holds, number {j} of all" for j in range(rng.randrange(3))]
        lines = [rng.choice(["", "  ", "\t\x0b"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", " ", "\r"]) for x in lines] + [""] * rng.randrange(2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines_match_brute_force(spark):
    rows = line_rows(5)
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[0][1]), (None, rows[0][1]), rows[3], rows[3], (7, rows[9][1]), (103, "\n".join(["a long document repeats this line again and again"] * 3000))]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("version", "pos", "hit", "keep", "size", "h1", "part", "n_lines")})
    check_lines(df, rows)
    check_lines(df, rows, min_chars=10, min_docs=2)
    check_lines(spark.createDataFrame([], DOC), [])


def test_a_line_that_most_documents_hold_spans_ranges(spark):
    hot = "This one line stands in nearly every document of the table."
    rows = [(i, f"{hot}\nand a line of its own for document number {i} only\n{hot}") for i in range(400)] + [(1000 + i, hot) for i in range(4)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        check_lines(spark.createDataFrame(rows, DOC).repartition(3), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("seed", range(6))
def test_streams_agree_however_lines_fall_into_batches_and_ranges(seed):
    """The stream of a range, and the sums of its edge keys, for every way to cut the sorted lines."""
    import pyarrow as pa

    rng = random.Random(seed)
    lines = sorted({(rng.randrange(5), 0, -rng.randrange(12), 0, 1, p) for p in range(4) for _ in range(60)})
    lines = [(a, b, -d, v, c, p) for a, b, d, v, c, p in lines]  # documents fall within a key
    cuts = sorted(rng.sample(range(1, len(lines)), 5))
    gone, late, edges = set(), [], []
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
        inner = sorted({a, b, *(rng.randrange(a, b + 1) for _ in range(3))})
        batches = [pa.RecordBatch.from_pylist([dict(zip(("h1", "h2", "doc_id", "version", "copies", "pos", "part"), (*x, part))) for x in lines[i:j]]) for i, j in zip(inner, inner[1:]) if i < j]
        for out in line_dedup._decide(5)(iter(batches)):
            for r in out.to_pylist():
                at = (r["h1"], r["doc_id"], r["pos"])
                {line_dedup.GONE: gone.add, line_dedup.OPEN: late.append, line_dedup.EDGE: lambda _: edges.append(r)}[r["kind"]](at)
    total, top, last = Counter(), {}, {}
    for e in sorted(edges, key=lambda e: e["part"]):
        k = e["h1"]
        total[k] += e["n"] - (last.get(k) == e["hi"])
        last[k], top[k] = e["lo"], max(e["hi"], top.get(k, -1))
    gone |= {x for x in late if total[x[0]] >= 5 and x[1] != top[x[0]]}
    docs = defaultdict(set)
    for h, _, d, *_ in lines:
        docs[h].add(d)
    assert gone == {(h, d, p) for h, _, d, _, _, p in lines if len(docs[h]) >= 5 and d != max(docs[h])}


def test_bitmaps_are_small_and_drop_the_right_lines(spark):
    rows = line_rows(6)
    want = {d: (n, kept) for d, _, n, kept in brute_lines(rows) if n}
    got = {r["doc_id"]: r for r in line_dedup.bitmaps(spark.createDataFrame(rows, DOC)).collect()}
    texts = dict(rows)
    assert {d: (r["n_dropped"], line_dedup.kept_lines(texts[d], r["keep"])) for d, r in got.items()} == want


# ---------------------------------------------------------------- importance resampling


def brute_draws(rows, target, percent=10, min_words=20, seed=2024, buckets=10000, max_n=1):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in feats(x)[0]), Counter(bucket(f) for x in target for f in feats(x)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for doc, text in rows:
        f, words = feats(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    drawn = able[: len(able) * percent // 100]
    left = Counter(out) - Counter(drawn)
    return [(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in left.elements()]


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)] + ["Ünïcode", "MiXed", "a-b", "x_y", "don't", "50%", "数据"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(n)]


def check_draws(spark, rows, target, **how):
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("score", "weight", "row", "rank", "place", "n_words")})
    got = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), **how)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert by_none(map(tuple, got.collect())) == by_none(brute_draws(rows, target, **how))


def test_draws_match_brute_force(spark):
    rows = list(enumerate(texts(7, 400))) + [(1000, None), (1001, ""), (1002, "-- !!"), (1003, "w" * 100000 + " end " * 20)]
    rows += [(None, texts(8, 1)[0] + " w" * 20)] * 2 + [rows[5]] * 30 + [(5, texts(9, 1)[0])]  # repeats, and another text of one doc_id
    check_draws(spark, rows, texts(10, 30) + [None, ""])


def test_draws_with_other_parameters_and_edges(spark):
    rows = list(enumerate(texts(11, 120)))
    check_draws(spark, rows, texts(12, 10), percent=50, min_words=0, seed=7, buckets=64, max_n=2)
    check_draws(spark, rows, [], percent=100)
    check_draws(spark, rows[:3], texts(12, 2))  # nothing is drawn
    check_draws(spark, [], texts(12, 2))


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    rng = random.Random(13)
    values = [rng.randrange(50) for _ in range(500)] + [50] * 400  # one score holds four rows in nine
    df = spark.createDataFrame([(v,) for v in values], "score long")
    for wanted in (1, 5, 399, 400, 401, 450, 899, 900):
        for margin, accuracy in ((1e-6, 10000), (0.005, 3)):  # a bracket of nothing, and a sketch of little worth
            lo, hi, above = importance.bracket(df, wanted, len(values), margin, accuracy)
            assert above == sum(v > hi for v in values) and above < wanted <= above + sum(lo <= v <= hi for v in values)
            assert lo <= sorted(values, reverse=True)[wanted - 1] <= hi


def test_places_are_global(spark):
    rng = random.Random(14)
    rows = [(rng.randrange(5), rng.choice([None, *range(40)]), rng.randrange(3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "score long, doc_id long, n_features long, row long")
    got = sorted((r["place"], r["row"]) for r in importance.ranked(df, "place").collect())
    want = [r[3] for r in sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1], r[2], r[3]))]
    assert got == list(enumerate(want, 1))
