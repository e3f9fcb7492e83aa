"""Operators over documents against brute force, on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import itertools
import random
import re

import pytest

from fleetspan.llm import jaccard, mixing, packing, passages, quality, token_rollup

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n))


def corpus():
    """Near copies, exact copies, short and odd texts, shared passages."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(40, 200)) for _ in range(12)]
    texts = list(base)
    for b in base[:6]:
        for _ in range(4):
            w = b.split()
            for _ in range(max(1, len(w) // 50)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[0].upper(), base[0].replace(" ", "\n"), base[1], base[1]]
    passage = sentence(rng, 80)
    texts += [f"{sentence(rng, 60)} {passage} {sentence(rng, 30)}" for _ in range(4)]
    fuzzy = passage.split()
    fuzzy[20], fuzzy[50] = "other", "word"
    texts.append(f"{sentence(rng, 40)} {' '.join(fuzzy)}")
    texts += [None, "", " \t\n", "one", "One", "one two three", "one two three four five", "ünïcode — ✓ " * 10, "x " * 3000]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "text without a number " * 3, None, None, 3), (None, base[2], None, None, 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame(rows, DOC), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def clash(spark, docs):
    """The same rows with columns named as the operators' own ones."""
    from pyspark.sql import functions as F

    return docs[0].select("*", *(F.lit(1).alias(c) for c in ("_gone", "rep", "token", "n", "_key", "_spans", "_rate", "_copies", "log_words", "score", "shard", "id")))


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(i, []).append(shingle_set(t))
    ids = [i for i in groups if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        for s, t in itertools.product(groups[a], groups[b]):
            both = len(s & t)
            if both and 100 * both >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_jaccard_components(docs):
    df, rows = docs
    out = jaccard.jaccard_components(df).collect()
    assert len(out) == len(rows)
    want = jaccard_brute(rows)
    sizes = {i: len(shingle_set(t)) for i, t, *_ in rows}
    for r in out:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["n_shingles"] == sizes[r["doc_id"]]
    # a document without a number joins the class that has one
    assert any(r["doc_id"] is None and r["component_id"] == want[2] for r in out)


def test_keep_one_keeps_columns_and_rows(docs, clash, empty):
    df, rows = docs
    want = jaccard_brute(rows)
    kept = jaccard.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, *_ in rows if i is not None and want[i] == i)
    assert jaccard.keep_one(empty).count() == 0 and jaccard.jaccard_components(empty).count() == 0


def test_prefix_order_has_no_say_in_the_result(spark):
    rng = random.Random(9)
    common = sentence(rng, 30)
    rows = [(i, f"{common} {sentence(rng, 3)}", "en", "s", 0) for i in range(60)] + [(100 + i, sentence(rng, 30), "en", "s", 0) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOC)).collect()}
    assert got == jaccard_brute(rows)


def test_texts_of_one_document_share_a_component(spark):
    rng = random.Random(21)
    one, two, three = sentence(rng, 60), sentence(rng, 60), sentence(rng, 60)
    rows = [(1, one), (2, two), (5, one), (5, two), (7, three), (8, None), (8, three), (9, None), (9, ""), (6, three + " more")]
    rows = [(i, t, "en", "s", 0) for i, t in rows]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, DOC)).collect()
    want = jaccard_brute(rows)
    assert want[5] == want[2] == 1 and want[8] == 6 and len(out) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in out} == set(want.items())


def test_all_links_on_demand(spark, monkeypatch):
    """every=True verifies each pair of different texts that links; blocks smaller than a group of near copies."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PAIRED", 5)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    rng = random.Random(22)
    rows = []
    for _ in range(3):
        base = sentence(rng, 80).split()
        for _ in range(12):
            w = list(base)
            w[rng.randrange(80)] = "changed"
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    rows += [(len(rows) + i, rows[i][1], "en", "s", 0) for i in range(4)]
    _, linked, _ = jaccard.links(spark.createDataFrame(rows, DOC), every=True)
    got = [tuple(sorted(r)) for r in linked.select("a", "b").collect()]
    sets, rep = {i: shingle_set(t) for i, t, *_ in rows}, {}
    for i, t, *_ in rows:
        rep.setdefault(t, i)
    want = {(a, b) for a, b in itertools.combinations(sorted(rep.values()), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_met_and_parted_lose_nothing(spark):
    """Hot keys, clashing names, nulls and a bitmap that is nearly full."""
    from pyspark.sql import functions as F

    from fleetspan.llm import common

    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("_word"), F.lit("x").alias("_bits"))
    right = common.stored(left.filter("k % 2 = 1").groupBy("k").agg(F.count("*").alias("size"), F.max("_word").alias("top")), "right")
    want = sorted(left.join(right.drop("size"), "k").collect())
    assert sorted(common.met(left, right, ["k"]).select("k", "_word", "_bits", "top").collect()) == want
    assert sorted(map(str, common.met(left, right, ["k"], "left").select("k", "_word", "_bits", "top").collect())) == sorted(map(str, left.join(right.drop("size"), "k", "left").collect()))
    for bits in (6, 10, 26):
        common.CELL_BITS = bits
        maybe, rest = common.parted(left, "k", right)
        assert maybe.columns == rest.columns == left.columns
        assert maybe.count() + rest.count() == 5000 and not rest.join(right, "k").count()
        assert sorted(maybe.join(right.drop("size"), "k").select("k", "_word", "_bits", "top").collect()) == want
    assert maybe.count() < 3500


def covered_brute(rows, n=passages.MIN_WORDS):
    first, texts = {}, {}
    for i, t, *_ in rows:
        if i is not None:
            texts.setdefault(i, words(t))
    for i in sorted(texts):
        for k in range(len(texts[i]) - n + 1):
            first.setdefault(tuple(texts[i][k : k + n]), i)
    out = {}
    for i, w in texts.items():
        m = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                m[k : k + n] = [True] * n
        out[i] = m
    return out


def test_passages_cover_all_exact_repeats(docs):
    df, rows = docs
    got = {}
    for r in passages.passages(df).collect():
        assert r["src_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= passages.MIN_WORDS
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    for i, m in covered_brute(rows).items():
        missed = [k for k, x in enumerate(m) if x and k not in got.get(i, ())]
        assert not missed, (i, missed[:5])
    fuzzy = next(i for i, t, *_ in rows if t and " other " in t and " word " in t)
    assert len(got[fuzzy]) >= 75  # the passage with two words changed is one


def fuzzy_repeats(rng, per=20):
    """Passages of 55 and 80 words in a first document, and once more with words changed: (rows, identity by doc_id, place of the repeat)."""
    rows, like = [], {}
    kinds = [(n, step, None) for n in (55, 80) for step in (20, 12, 10, 7)] + [(n, None, share) for n in (55, 80) for share in (0.05, 0.1, 0.15)]
    for n, step, share in kinds:
        for _ in range(per):
            i = 2 * len(like)
            p = sentence(rng, n).split()
            q = [f"new{k}" if (step and k % step == step // 2) or (share and rng.random() < share) else w for k, w in enumerate(p)]
            rows += [(i, f"{sentence(rng, 40)} {' '.join(p)} {sentence(rng, 40)}", "en", "s", 0), (i + 1, f"{sentence(rng, 40)} {' '.join(q)} {sentence(rng, 40)}", "en", "s", 0)]
            like[i + 1] = (sum(a == b for a, b in zip(p, q)) / n, n)
    return rows, like


def test_passages_find_fuzzy_repeats(spark):
    """Recall of passages above the identity, against the planted ones; exact repeats have a test of their own."""
    rows, like = fuzzy_repeats(random.Random(11))
    got = {}
    for r in passages.passages(spark.createDataFrame(rows, DOC)).collect():
        assert r["src_doc_id"] < r["doc_id"] and r["n_equal"] >= passages.IDENTITY * (r["end_word"] - r["start_word"])
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    due = [i for i, (share, _) in like.items() if share >= 0.83]
    found = [i for i in due if len(got.get(i, set()) & set(range(40, 40 + like[i][1]))) >= 0.8 * like[i][1]]
    assert len(due) > 200 and len(found) >= 0.95 * len(due), (len(found), len(due))


def uncovered(spark, rows):
    """Words that brute force marks and no passage covers, by document."""
    got = {}
    for r in passages.passages(spark.createDataFrame(rows, DOC)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    missed = {i: [k for k, x in enumerate(m) if x and k not in got.get(i, ())] for i, m in covered_brute(rows).items()}
    return {i: m for i, m in missed.items() if m}


def test_passages_twice_in_a_document(spark):
    rng = random.Random(12)
    p, q = sentence(rng, 60), sentence(rng, 55)
    head = " ".join(q.split()[:30])
    texts = [p, q, f"{sentence(rng, 20)} {p} {sentence(rng, 30)} {p} {sentence(rng, 30)}", f"{head} {sentence(rng, 9)} {' '.join(q.split()[25:])} {sentence(rng, 30)} {q} {sentence(rng, 30)}"]
    assert not uncovered(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])


def test_passages_of_lines_that_others_hold_apart(spark):
    """Frequent lines stand alone in many documents, and in a row in two of them."""
    rng = random.Random(13)
    a, b = sentence(rng, 28), sentence(rng, 28)
    alone = lambda n: [f"{sentence(rng, 15)} {x} {sentence(rng, 15)}" for x in (a, b) * n]
    texts = [f"{a} {sentence(rng, 40)} {b}", *alone(2), f"{sentence(rng, 5)} {a} {b}", *alone(5), f"{a} {b} {sentence(rng, 5)}"]
    assert not uncovered(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])


def test_passages_of_hot_seeds(spark):
    """Seeds found hot on a sample of all documents, in ranges of doc_id, give the same passages as seeds that aren't."""
    rng = random.Random(14)
    line, long = sentence(rng, 12), sentence(rng, 70)
    texts = [f"{sentence(rng, 10)} {line} {sentence(rng, 20)} {long if i % 7 == 3 else sentence(rng, 30)} {line} {sentence(rng, 5)}" for i in range(150)]
    texts += ["again " * 200, "once " + "again " * 150, "again " * 90]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    held = [sorted(map(tuple, passages.holders(passages.held_seeds(df, n)).collect()), key=str) for n in (1, 1 << 40)]
    assert passages.hot_seeds(df, 1).count() > 0 and passages.hot_seeds(df, 1 << 40).count() == 0
    assert held[0] == held[1]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    assert not uncovered(spark, rows)


def test_passages_seeds_travel_in_groups(spark):
    """First and nearest earlier holders are those of brute force, and a task deals a row for each group of seeds, not for each seed."""
    import numpy as np

    rng = random.Random(16)
    lines = [sentence(rng, 14) for _ in range(12)]
    texts = [" ".join(rng.choice(lines) if rng.random() < 0.5 else sentence(rng, 9) for _ in range(rng.randrange(12))) for _ in range(60)]
    df = spark.createDataFrame([(i * 3, t, "en", "s", 0) for i, t in enumerate(texts)], DOC).coalesce(1)
    by_seed = {}
    for doc, pos, seed, _ in sorted(map(tuple, passages.seeds(df).collect())):
        by_seed.setdefault(seed, {}).setdefault(doc, []).append(pos)
    want = []
    for held in by_seed.values():
        ids = list(held)
        for k, doc in enumerate(ids if len(ids) > 1 else []):
            near = (ids[k - 1], held[ids[k - 1]][0]) if k else (None, None)
            want += [(doc, pos, ids[0], held[ids[0]][0], *near) for pos in held[doc]]
    got = passages.holders(passages.held_seeds(df, 1 << 40)).select("doc", "pos", "src", "src_pos", "near", "near_pos")
    assert want and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    dealt = passages._dealt(df, np.zeros(0, np.int64), np.zeros(0, np.int64), 4).collect()
    assert len(dealt) == 4 and sum(len(r["seed"]) for r in dealt) == passages.seeds(df).count() > 1000


def test_passages_seven_documents(spark):
    """Halves of a passage stand in several documents, the whole in the third and the sixth."""
    rng = random.Random(15)
    p = sentence(rng, 70).split()
    one, two = " ".join(p[:35]), " ".join(p[35:])
    w = lambda x: f"{sentence(rng, 25)} {x} {sentence(rng, 25)}"
    texts = [w("none"), w(one), w(two), w(" ".join(p)), w(one), w(two), w(" ".join(p))]
    assert not uncovered(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])


@pytest.mark.parametrize("hot", [1, 1 << 40])
def test_passages_meet_every_holder_on_request(spark, hot):
    """Only the third document holds both halves, and it is neither first nor nearest for either; the last has a word changed between them."""
    rng = random.Random(11)
    a, b = sentence(rng, 30), sentence(rng, 30)
    around = lambda x: f"{sentence(rng, 40)} {x} {sentence(rng, 40)}"
    texts = [around(a), around(b), around(f"{a} {b}"), around(a), around(b), around(f"{a} changedword {' '.join(b.split()[1:])}")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    found = [r for r in passages.passages(df, hot, every=True).collect() if r["doc_id"] == 5]
    assert [(r["src_doc_id"], r["n_equal"]) for r in found if r["end_word"] - r["start_word"] >= 60] == [(2, 59)]


def test_passages_remove_text(docs, clash, empty):
    df, rows = docs
    found = passages.passages(df)
    out = passages.remove(clash, found)
    assert out.columns == clash.columns and out.count() == len(rows)
    spans = {r["doc_id"]: [(s["s"], s["e"]) for s in r["spans"]] for r in passages.merged(found).collect()}
    texts = {i: t for i, t, *_ in rows if i is not None}
    for r in out.collect():
        if r["doc_id"] is not None:
            gone = {k for s, e in spans.get(r["doc_id"], []) for k in range(s, e)}
            assert words(r["text"]) == [w for k, w in enumerate(words(texts[r["doc_id"]])) if k not in gone]
            if gone:
                assert r["n_chars"] == len(r["text"])
    assert passages.passages(empty).count() == 0 and passages.remove(empty, passages.passages(empty)).count() == 0


def test_chains_maximise_score_with_gap_costs():
    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        pts = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(12)})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        best = [0.0] * len(pts)
        for i in range(len(pts)):
            best[i] = passages.K
            joins = [(best[j] - passages.GAP * (x[i] - x[j] + y[i] - y[j]), j) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            if joins:
                top = max(joins)[0]
                near = [passages.K - max(0, passages.K - min(x[i] - x[j], y[i] - y[j])) for v, j in joins if v == top]
                if top > 0:
                    best[i] = max(near) + top
        for cx, cy in passages.chains(x, y):
            assert (np.diff(cx) > 0).all() and (np.diff(cy) > 0).all()
        used = [set(zip(cx.tolist(), cy.tolist())) for cx, cy in passages.chains(x, y)]
        assert sum(map(len, used)) == len(set().union(*used)) if used else True


def labelled(spark, n=160):
    """Prose is good; repeated, symbol-ridden and shouting texts are not. Toxic texts hold a word of their own."""
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        good = i % 4 != 0
        toxic = i % 5 == 0
        w = [rng.choice("the of and with river stone light water under house green over small which from".split()) for _ in range(rng.randint(30, 120))]
        if toxic:
            w[len(w) // 2] = "vilesome"
        text = " ".join(w) if good else " ".join(f"{x}###" for x in w) if i % 8 else " ".join([w[0]] * 60 + ["vilesome"] * toxic)
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, int(good), int(toxic)))
    marks += [(None, 1, 0), (3, None, None), (99999, 1, 1)]
    return spark.createDataFrame(rows + [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "a b", "en", "s", 3)], DOC), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_held_out_accuracy(spark, empty):
    import zlib

    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    out = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    held = [i for i in truth if i in out and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out if i is not None)
    assert held and sum(out[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert model.weights and len(out) == docs.count()
    assert quality.score(empty, model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_labels_held_out_are_not_learned(spark):
    docs, labels = labelled(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_quality_accept_keeps_columns(spark, clash):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    out = quality.accept(clash, model)
    want = [r["predicted"] for r in quality.score(clash, model).collect()]
    assert out.columns == clash.columns and out.count() == sum(want)


def test_mixing_meets_targets(spark, empty, clash):
    docs, labels = labelled(spark)
    targets = {"junk": 0.1, "junk_toxic": 0.1, "clean": 0.6, "clean_toxic": 0.2}
    rows = mixing.rates(docs, labels, targets).collect()
    assert len(rows) == docs.count() and all(0 <= r["rate"] <= mixing.MOST for r in rows)
    total = sum(r["tokens"] for r in rows)
    for d in mixing.DOMAINS:
        got = sum(r["tokens"] * r[f"p_{d}"] * r["rate"] for r in rows)
        assert abs(got / total - targets[d]) < 0.01, d
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-6 for r in rows)
    assert all(r["rate"] == 1 for r in rows if r["tokens"] == 0)
    assert mixing.rates(empty, labels).count() == 0
    mixed = mixing.mix(docs, labels, targets)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(clash, labels, targets).columns == clash.columns


def members_of(spark, t, p):
    return spark.createDataFrame([(int(x), *map(float, y)) for x, y in zip(t, p)], "tokens long, p0 double, p1 double, p2 double, p3 double").repartition(3)


def test_mixing_meets_what_can_be_met_and_proves_what_cannot(spark):
    """Against the optimality conditions of the least-squares problem, on random posteriors, blunt and sharp."""
    import warnings

    import numpy as np

    rng = np.random.default_rng(4)
    seen = set()
    for sharp, shares in itertools.product((2, 5), ([0.1, 0.02, 0.83, 0.05], [0.3, 0.1, 0.5, 0.1], [0.02, 0.002, 0.97, 0.008])):
        n = 1500
        z = rng.standard_normal((n, 4)) + np.log(shares)
        z[np.arange(n), rng.choice(4, n, p=shares)] += sharp
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        t = rng.integers(0, 500, n).astype(float)
        targets = dict(zip(mixing.DOMAINS, (0.01, 0.005, 0.96, 0.025)))
        with warnings.catch_warnings(record=True) as told:
            warnings.simplefilter("always")
            found = mixing.solve(members_of(spark, t, p), targets)
        told = [w for w in told if "mixing" in str(w.message)]
        r = mixing._rates(t, p, found.steps)
        totals = p.T @ (t * r)
        assert (r >= 0).all() and np.allclose(totals, found.totals, rtol=1e-9)
        goals = t.sum() * np.array(list(targets.values()))
        seen.add(found.met)
        if found.met:
            assert np.abs(totals - goals).max() <= 1.1e-6 * t.sum() and not told
            continue
        # no direction that keeps rates >= 0 makes the sum smaller: proof that the goals can't be met
        slope = p @ ((totals - goals) / goals)
        slope = np.where(r > 0, slope, np.minimum(slope, 0))
        assert np.sqrt((t * slope**2).sum() / t.sum()) < 1e-3 and told and max(map(abs, found.residuals().values())) > 1e-6
    assert True in seen


def test_mixing_ends_at_the_optimum_when_a_domain_is_gone(spark):
    """As after the quality filter: next to no junk is left. The projected gradient of squares and ridge vanishes, in few passes, and clean text stays."""
    import warnings

    import numpy as np

    rng = np.random.default_rng(6)
    for gone in (1e-9, 1e-5, 1e-3):
        n = 2000
        toxic = (rng.random(n) < 0.06) * 0.97
        junk = rng.random(n) * gone
        p = np.stack([junk, junk / 2, 1 - toxic - junk * 1.5, toxic], axis=1)
        t = rng.integers(1, 900, n).astype(float)
        with warnings.catch_warnings(record=True):
            warnings.simplefilter("always")
            found = mixing.solve(members_of(spark, t, p), mixing.TARGETS, keep="clean")
        r = mixing._rates(t, p, found.steps)
        totals = p.T @ (t * r)
        assert np.allclose(totals, found.totals, rtol=1e-9) and not found.met and found.passes < 30 and found.gradient <= 1e-6
        slope = p @ ((totals - found.goals) / found.goals) + mixing.RIDGE * (r - 1)
        slope = np.where(r > 0, slope, np.minimum(slope, 0))
        assert np.sqrt((t * slope**2).sum() / t.sum()) <= 1e-6
        shares = np.abs(list(found.residuals().values()))
        assert shares[2:].max() < 2e-3  # what can be met is met
        if gone < 1e-4:  # nothing to draw it from: clean text stays
            assert np.maximum(0, 1 - r[toxic == 0]).mean() < 0.1


def test_mixing_infeasible_and_scarce_targets(spark):
    import warnings

    import numpy as np

    rng = np.random.default_rng(5)
    # nobody is more than a tenth junk, so half junk can't be had: the best there is, is a tenth
    x = rng.uniform(0, 0.1, 400)
    p = np.stack([x, np.zeros(400), 1 - x, np.zeros(400)], axis=1)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        found = mixing.solve(members_of(spark, np.full(400, 100), p), {"junk": 0.5, "junk_toxic": 0, "clean": 0.5, "clean_toxic": 0})
    assert not found.met and told and found.residuals()["junk"] < -0.2
    # a scarce domain is met all the same, and one that is kept loses nothing
    p = np.tile([0.01, 0.0, 0.99, 0.0], (1000, 1))
    p[7] = [0.0, 0.0, 0.0, 1.0]
    found = mixing.solve(members_of(spark, np.full(1000, 100), p), {"junk": 0.0098, "junk_toxic": 0, "clean": 0.9702, "clean_toxic": 0.02}, keep="clean")
    r = mixing._rates(np.full(1000, 100.0), p, found.steps)
    assert found.met and abs(r[7] - 1000 / 0.9702 * 0.99 * 0.02) < 0.3 and abs(np.delete(r, 7).mean() - 1) < 1e-3


def test_mixing_repeats(spark):
    """Rows without doc_id have fractions of their own by their texts; a text repeated under one doc_id shares its fraction."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, f"t{i % 200}", "en", "s", 0) for i in range(400)], DOC)
    x = df.groupBy("text").agg(F.countDistinct(mixing.fraction(F.col("doc_id"), F.xxhash64("text"))).alias("n"), F.first(mixing.fraction(F.col("doc_id"), F.xxhash64("text"))).alias("f")).collect()
    assert {r["n"] for r in x} == {1} and 0.4 < sum(r["f"] for r in x) / len(x) < 0.6


def test_packing_is_sound(docs, empty, clash):
    df, rows = docs
    out = packing.packed(df, lengths=(64, 256), overhead=4, shard=16).collect()
    total = sum(len(words(t)) for _, t, *_ in rows)
    assert sum(r["n_tokens"] for r in out) == total
    bins = {}
    for r in out:
        if r["n_tokens"]:
            bins.setdefault(r["bin_id"], []).append(r)
        else:
            assert r["bin_id"] is None
    for b in bins.values():
        b.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in b:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        cap = b[0]["bin_capacity"]
        assert at <= cap == min(c for c in (64, 256) if c >= at)  # downsized to its contents
    assert packing.packed(empty).count() == 0 and packing.packed(clash).count() == packing.packed(df).count()


def test_best_fit_choices():
    import numpy as np

    put, capacity = packing.best_fit(np.array([6, 5, 4, 3]), (10,), 0)
    assert put.tolist() == [0, 1, 0, 1] and capacity == [10, 10]
    put, _, caps = packing.pack(np.array([100, 3, 3]), (4, 8, 128), 1)
    assert put[1] == put[0] == put[2] and set(caps) == {128}


def test_packing_is_best_fit_at_every_step():
    """Each item against all open bins, each opened bin against all lengths, each largest length against the others."""
    import numpy as np

    rng = random.Random(41)
    for _ in range(60):
        lengths = tuple(sorted(rng.sample((8, 16, 24, 40, 64, 100), rng.randint(1, 4))))
        overhead = rng.choice((0, 2, 9))
        sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(1, 60))), reverse=True)
        costs = []
        for top in lengths:
            if top < sizes[0]:
                continue
            usable = tuple(c for c in lengths if c <= top)
            put, capacity = packing.best_fit(np.array(sizes), usable, overhead)
            room, rest = {}, sum(sizes)
            for s, k in zip(sizes, put.tolist()):
                fits = [r for r in room.values() if r >= s]
                if k in room:
                    assert room[k] == min(fits)
                else:
                    assert not fits and capacity[k] == min((c for c in usable if c >= s), key=lambda c: ((c + overhead) / min(c, rest), c))
                room[k] = room.get(k, capacity[k]) - s
                rest -= s
            costs.append(sum(min(c for c in lengths if c >= capacity[k] - r) + overhead for k, r in room.items()))
        order = rng.sample(range(len(sizes)), len(sizes))
        put, offset, caps = packing.pack(np.array([sizes[i] for i in order]), lengths, overhead)
        used = {}
        for k, o, i in sorted(zip(put.tolist(), offset.tolist(), order)):
            assert used.get(k, 0) == o
            used[k] = o + sizes[i]
        assert all(caps[j] == min(c for c in lengths if c >= used[k]) for j, k in enumerate(put))
        assert sum(min(c for c in lengths if c >= u) + overhead for u in used.values()) == min(costs)


def test_packing_spreads_one_hot_id(spark):
    df = spark.createDataFrame([(7, "a b c", "en", "s", 5)] * 3000 + [(None, "a b", "en", "s", 3)] * 1000, DOC)
    out = packing.packed(df, shard=100).collect()
    sizes = {}
    for r in out:
        sizes[r["bin_id"] >> 32] = sizes.get(r["bin_id"] >> 32, 0) + 1
    assert len(out) == 4000 and len(sizes) >= 38 and max(sizes.values()) < 250


def naive_stats(text):
    """The statistics of quality.STATS, word by word."""
    import math

    raw = (text or "").encode()
    w = words(text)
    if not w:
        return [0.0] * len(quality.STATS)
    symbols, digits, punct, blank = b"#$%&*!<>=+~^@_{}[]\\/", b"0123456789", b".,;:?'\"()-", b" \t\r\f\v"
    count = lambda kind: sum(c in kind for c in raw)
    lines, solid = count(b"\n"), len(raw) - count(b"\n" + blank)
    upper = sum(65 <= c <= 90 for c in raw)
    letters = len(raw) - count(symbols + digits + punct + blank + b"\n|")
    triples = [tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    stretches = re.split(rb"[ \t\r\f\v\n]", raw)
    ends = sum(1 for i, c in enumerate(raw) if c in symbols and (i + 1 == len(raw) or raw[i + 1] in blank + b"\n"))
    whole = raw.split(b"\n") if lines else [b""]
    return [math.log1p(len(w)), solid / len(w), upper / max(1, letters), count(symbols) / max(1, solid), count(digits) / max(1, solid), count(punct) / max(1, solid), math.log1p(len(w) / (lines + 1)), count(b"|") / len(w),
            len(set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w), len(set(triples)) / len(triples), len(set(whole)) / len(whole), math.log1p(max(map(len, stretches))), ends / len(w)]


def test_quality_scores_are_the_rules_by_hand(spark, docs):
    """Statistics against a plain count, and scores against the rules evaluated one by one."""
    import math

    import numpy as np
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus()] + ["A|B|C\n1|2|3\nA|B|C", "Wow! So $$$ much ### here!!! 100% \u2713", "one  two\t\tthree\x0bfour"]
    got = quality.text_stats(pa.array(texts))
    assert np.allclose(got, [naive_stats(t) for t in texts], atol=1e-12)
    model = quality.fit(*labelled(spark))
    df, rows = docs
    for r in quality.score(df.filter("doc_id is not null").dropDuplicates(["doc_id"]), model).collect():
        stats = dict(zip(quality.STATS, naive_stats(next(t for i, t, *_ in rows if i == r["doc_id"]))))
        z = model.intercept + sum(w * all((stats[n] > t) == above for n, above, t in rule.terms) for rule, w in model.weights)
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_token_rollup_against_rebuild(spark, docs, empty):
    df, _ = docs
    from pyspark.sql import functions as F

    from fleetspan.llm.common import scratch

    counters = {"words-1": token_rollup.word_counter, "bpe": token_rollup.bpe_counter}
    store = token_rollup.RollupStore(spark, scratch(spark, "t"), counters)
    base = df.filter("doc_id is not null").dropDuplicates(["doc_id"])
    change = lambda x, op: x.select(F.lit(op).alias("op"), "doc_id", "text", "source", "lang")
    assert store.commit(1, change(base, "insert"))
    after1 = {tuple(r) for r in store.totals().collect()}
    assert after1 == {tuple(r) for r in token_rollup.rebuild(base, counters).collect()}
    gone, new = base.filter("doc_id % 3 = 0"), base.filter("doc_id % 3 = 1").withColumns({"text": F.lit("two words"), "source": F.lit("moved")})
    unknown = spark.createDataFrame([(777_777, "x", "en", "s", 1), (None, "x", "en", "s", 1)], DOC)
    batch = change(gone, "delete").union(change(new, "revise")).union(change(unknown, "delete"))
    assert store.commit(2, batch)
    assert not store.commit(2, batch) and not store.commit(1, change(base, "insert"))
    left = base.filter("doc_id % 3 = 2").unionByName(new)
    assert {tuple(r) for r in store.totals().collect()} == {tuple(r) for r in token_rollup.rebuild(left, counters).collect()}
    assert store.commit(3, change(gone, "insert"))  # what was deleted may come back
    assert {tuple(r) for r in store.totals().collect()} == {tuple(r) for r in token_rollup.rebuild(left.unionByName(gone), counters).collect()}
    assert store.commit(4, change(empty, "insert"))
    assert token_rollup.RollupStore(spark, scratch(spark, "t"), counters).totals().count() == 0


def test_broken_commit_is_taken_up_again(spark, docs):
    from pyspark.sql import functions as F

    from fleetspan.llm.common import scratch

    df, _ = docs
    store = token_rollup.RollupStore(spark, scratch(spark, "t"), {"words-1": token_rollup.word_counter})
    rows = df.filter("doc_id < 5").dropDuplicates(["doc_id"]).select(F.lit("insert").alias("op"), "doc_id", "text", "source", "lang")
    rows.limit(1).write.parquet(f"{store.path}/delta/000000000001")  # leavings without a marker
    assert store.totals().count() == 0 and store.commit(1, rows)
    assert store.totals().agg(F.sum("n_docs")).first()[0] == 5


def test_commits_count_in_their_order(spark):
    """Batch numbers out of order, many batches with compaction between them, and a store opened anew."""
    from pyspark.sql import functions as F

    from fleetspan.llm.common import scratch

    rng = random.Random(31)
    path, counters = scratch(spark, "t"), {"words-1": token_rollup.word_counter}
    store = token_rollup.RollupStore(spark, path, counters, compact=3)
    rows = lambda x: spark.createDataFrame(x, "op string, doc_id long, text string, source string, lang string")
    now = {}
    for batch in (1, 3, 2, 9, 4, 5, 8, 7):
        part = []
        for i in rng.sample(range(12), 4):
            op = rng.choice(("insert", "revise", "delete")) if batch != 7 else "delete"
            text = sentence(rng, rng.randint(0, 9))
            part.append((op, i, text, f"s{rng.randrange(3)}", None))
            now.pop(i, None)
            if op != "delete":
                now[i] = part[-1]
        assert store.commit(batch, rows(part))
        want = {}
        for _, _, text, source, _ in now.values():
            n, t = want.get(source, (0, 0))
            want[source] = (n + 1, t + len(text.split()))
        assert {r["source"]: (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()} == want, batch
    store = token_rollup.RollupStore(spark, path, counters)
    assert store.batches() == [1, 3, 2, 9, 4, 5, 8, 7] and not store.commit(3, rows([("insert", 1, "x", "s", None)]))
    assert len(store._folders(store.log())) <= 4
    everything = rows([("delete", i, None, None, None) for i in range(12)])
    assert store.commit(10, everything) and store.totals().count() == 0


def test_two_writers_of_one_batch(spark):
    from concurrent.futures import ThreadPoolExecutor

    from fleetspan.llm.common import hadoop, scratch

    path, counters = scratch(spark, "t"), {"words-1": token_rollup.word_counter}
    rows = spark.createDataFrame([("insert", i, "two words", "s", "en") for i in range(20)], "op string, doc_id long, text string, source string, lang string")
    commit = lambda batch: token_rollup.RollupStore(spark, path, counters).commit(batch, rows)
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(commit, (1, 1, 2)))
    assert sorted(done[:2]) == [False, True] and done[2]
    store = token_rollup.RollupStore(spark, path, counters)
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "words-1", 20, 40)]
    fs, p = hadoop(spark, f"{path}/log/000000000002")
    fs.create(p, False).close()  # a writer that died
    assert store.commit(3, rows) and store.totals().first()["n_docs"] == 20
