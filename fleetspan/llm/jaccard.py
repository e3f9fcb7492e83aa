"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents are sets of distinct word shingles. Two link when ``100 * |A & B| >= percent * |A | B|``. The steps:

1. Frequencies: every task counts all its shingles in a fixed number of cells; the counts are added up. Shingles are ordered
   by the frequency class of their cell, then by hash: one order for the whole corpus, rarest first.
2. One pass gives each document's set size, a 128-bit hash of its word sequence and its prefix in that order. Documents with the
   same words are one class; the class with the smallest doc_id stands for them.
3. Classes meet on prefix shingles. Each meets the first class of every shingle it shares (one row per member, no pairs within
   a group); pairs that pass the length and positional filters, then the suffix filter, are verified once, on whole texts.
4. Where a shingle's classes are still in several components, its classes are joined, or, if they are many, compared block by block: pairs across
   components that pass all filters leave the block and are verified. So every link between different texts either is verified
   or joins two documents that verified links join already; with ``every=True`` all pairs that pass the filters are verified.

Shingles, classes and pivots that very many rows share are hot keys, kept out of the shuffles by ``common.met``; texts that no pair names
stay where they are (``common.parted``).

Defined results: null or word-less text gives an empty set, linked with nothing. Repeated rows are rows of their own, in one
class; rows that share a doc_id are one document, linked if one of their texts is, with one component for all of them. A null doc_id never
names a component unless all members of a class lack one. An empty table gives an empty result.
Other columns of the table are not read. Ties in the order are broken by hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import discard, fresh, met, parted, stored
from .components import components

#: Cells of the frequency counts, as a power of two. With 2^18 a frequent line's shingles didn't stand out among their cells at 0.5 GB,
#: came early in the order and joined many documents; 4 MB a task is still fixed.
CELL_BITS = 20
PARTS = 16
#: Members of one pivot that one verification group holds at most, and shingles of all its texts together (a single text may have more).
GROUP = 256
GROUP_SHINGLES = 1 << 20
#: Classes of one shingle that are compared with as many others at once; those of a shingle that fewer have than PAIRED are simply joined.
BLOCK = 512
PAIRED = 64
#: Rows of one group of blocks.
CELL = 8192


def frequencies(docs: DataFrame, size: int, bits: int = CELL_BITS) -> np.ndarray:
    """Occurrences of all shingles of docs.text, counted in 2^bits cells. Memory and traffic of a task don't grow with its rows."""
    cells, piece = 1 << bits, 1 << max(0, bits - 6)

    def count(batches):
        total = np.zeros(cells, dtype=np.uint32)  # of one task; the sums are wider
        for batch in batches:
            for i, j, h, o in tk.word_hashes(batch.column(0)):
                n = np.diff(o)
                if len(h) >= size:
                    doc = np.repeat(np.arange(j - i), n)
                    ok = doc[: len(h) - size + 1] == doc[size - 1 :]
                    sh = tk.shingles(h, size)[ok]
                    total += np.bincount((sh >> np.uint64(64 - bits)).astype(np.int64), minlength=cells).astype(np.uint32)
        parts = total.reshape(-1, piece)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "counts"])

    def merge(key, table):
        total = np.zeros(piece, dtype=np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), dtype=np.uint32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).groupBy("part").applyInArrow(merge, kind).collect()
    out = np.zeros((cells // piece, piece), dtype=np.int64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return out.reshape(-1)


def signatures(docs: DataFrame, size: int, percent: int, classes: np.ndarray, bits: int = CELL_BITS) -> DataFrame:
    """One row per document: doc_id, n (set size), h1, h2 (of the word sequence), prefix (rarest first), parts (see suffix filter)."""
    shift = np.uint64(64 - bits)

    def sign(batches):
        for batch in batches:
            n, h1, h2, prefix, lens, parts = [], [], [], [], [], []
            for _, s, w in tk.shingle_sets(batch.column(1), size):
                n.append(len(s))
                a, b = tk.sequence_hash(w) if len(w) else (0, 0)
                h1.append(a)
                h2.append(b)
                k = len(s) + (-percent * len(s)) // 100 + 1 if len(s) else 0  # n - ceil(percent n / 100) + 1
                order = np.argsort(classes[(s >> shift).astype(np.int64)], kind="stable")[:k]
                prefix.append(s[order].view(np.int64))
                lens.append(k)
                parts.append(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32))
            offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * PARTS), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))],
                ["doc_id", "n", "h1", "h2", "prefix", "parts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n int, h1 long, h2 long, prefix array<long>, parts array<int>")


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Small integers that grow with the count, so that they sort in linear time; four to each doubling."""
    return np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8)


def least_overlap(na, nb, percent: int):
    """ceil(percent * (na + nb) / (100 + percent)) as a column or array expression."""
    return (percent * (na + nb) + 99 + percent) // (100 + percent)


def _overlap_sql(percent: int) -> str:
    return f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"


def _keep_sql(percent: int) -> str:
    """Length and positional filter."""
    return f"nb * 100 >= na * {percent} and na * 100 >= nb * {percent} and least(na - pa, nb - pb) >= {_overlap_sql(percent)}"


def _suffix(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: shingles fall into parts by hash; the sizes of the parts bound how many shingles two sets can't share. Gives a, b, na."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size"))
    a = stored(sizes.join(reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa")).hint("merge"), "a"), "firsts")
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return met(pairs, a, ["a"]).join(b.hint("merge"), "b").filter(apart <= F.expr(f"na + nb - 2 * ({_overlap_sql(percent)})")).select("a", "b", "na").distinct()


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole texts link. pairs: a stored table of distinct rows (a, b, na), na the shingles of a.

    Each group holds one document a and GROUP others or GROUP_SHINGLES shingles at most; a's text goes to each of its groups.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    counts = pairs.groupBy("a").agg(F.count("*").alias("size"), F.max("na").alias("na"))
    counts = stored(counts.withColumn("groups", F.ceil(F.col("size") / F.greatest(F.lit(1), F.least(F.lit(GROUP), F.expr(f"{GROUP_SHINGLES} div (na + 1)")))).cast("int")).select("a", "size", "groups"), "counts")
    ranked = met(pairs.select("a", "b"), counts, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("g"))
    both = F.array(F.struct(F.col("a").alias("id"), F.lit(True).alias("first")), F.struct(F.col("b").alias("id"), F.lit(False).alias("first")))
    wanted = stored(ranked.select("a", "g", F.explode(both).alias("x")).select("x.id", "a", "g", "x.first").distinct(), "wanted")
    have = parted(texts, "id", wanted)[0].join(wanted.hint("merge"), "id")

    def check(_, table):
        first = table.column("first").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        sets = [s for _, s, _ in tk.shingle_sets(table.column("text").combine_chunks(), size)] if table.num_rows else []
        pivots = [s for s, f in zip(sets, first) if f]
        out = {}
        for s, f, i in zip(sets, first, ids):
            if not f and not out.get(i):
                both = [len(np.intersect1d(p, s, assume_unique=True)) for p in pivots]
                out[i] = any(100 * x >= percent * (len(p) + len(s) - x) for p, x in zip(pivots, both))
        b = [i for i, ok in out.items() if ok]
        a = table.column("a")[0].as_py() if table.num_rows else None
        return pa.table({"a": pa.array([a] * len(b), pa.int64()), "b": pa.array(b, pa.int64())})

    return have.groupBy("a", "g").applyInArrow(check, "a long, b long")


def _across(percent: int):
    """Pairs of the two blocks of a group of classes that share a shingle and pass all filters, each in another component."""

    def run(table):
        table = table.sort_by([("token", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
        rep, n, pos, comp, block, token, i, j = (table.column(c).to_numpy() for c in ("rep", "n", "pos", "comp", "block", "token", "i", "j"))
        parts = table.column("parts").combine_chunks().flatten().to_numpy().reshape(-1, PARTS).astype(np.int32)
        n = n.astype(np.int64)
        heads = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        out = [[np.zeros(0, np.int64)] * 3]
        for lo, hi in zip(heads, np.append(heads[1:], len(rep))):
            left = lo + np.flatnonzero(block[lo:hi] == i[lo])
            right = left if i[lo] == j[lo] else lo + np.flatnonzero(block[lo:hi] == j[lo])
            for x in left:
                y = right[(rep[right] > rep[x]) | (i[lo] != j[lo])]
                y = y[(comp[y] != comp[x]) & (rep[y] != rep[x])]
                y = y[(n[y] * 100 >= n[x] * percent) & (n[x] * 100 >= n[y] * percent)]
                least = least_overlap(n[x], n[y], percent)
                ok = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= least
                ok[ok] = np.abs(parts[y[ok]] - parts[x]).sum(axis=1) <= (n[x] + n[y] - 2 * least)[ok]
                y = y[ok]
                if len(y):
                    low = rep[x] < rep[y]
                    out.append([np.where(low, rep[x], rep[y]), np.where(low, rep[y], rep[x]), np.where(low, n[x], n[y])])
        a, b, na = (np.concatenate(c) for c in zip(*out))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "na": pa.array(na.astype(np.int32), pa.int32())})

    return run


def _cross(placed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na) of classes in different components that share a shingle and pass all filters. placed: token, rep, n, pos, comp."""
    split = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    split = stored(split.select("token", "size", F.col("size").alias("of")), "split")
    few = placed.join(split.filter(F.col("size") < PAIRED).select("token").hint("merge"), "token")
    x = few.select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    y = few.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
    # PAIRED rows for each at most
    pairs = stored(x.join(y.hint("merge"), "token").filter("a < b and ca <> cb").filter(_keep_sql(percent)).select("a", "b").distinct(), "pairs")
    pairs = _suffix(pairs, reps, percent)
    many = stored(split.filter(F.col("size") >= PAIRED), "many")
    total = many.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return pairs
    rows = met(parted(placed, "token", many)[0], many, ["token"]).withColumn("blocks", F.ceil(F.col("of") / BLOCK).cast("int"))
    rows = rows.join(reps.select("rep", "parts").hint("merge"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("token"), F.lit(math.ceil(total / CELL)))).otherwise(F.xxhash64("token", i, j))
    dealt = rows.select("token", "rep", "n", "pos", "comp", "parts", "block", i.alias("i"), j.alias("j"), cell.alias("cell"), "blocks")
    return pairs.union(dealt.groupBy("cell", F.col("blocks") == 1).applyInArrow(_across(percent), "a long, b long, na int"))


def _members(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, h1, h2 and rep of every row, classes h1, h2, rep, size): rep is the smallest doc_id with the same words."""
    same = stored(signed.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).filter("rep is not null"), "classes")
    rows = signed.select("doc_id", "n", "h1", "h2")
    # a row alone in its class stays where it is
    maybe, rest = parted(rows, "h1", same.filter("size > 1"))
    maybe = met(maybe, same, ["h1", "h2"], "left").select("doc_id", "n", "h1", "h2", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    return stored(maybe.union(rest.select("*", F.when(F.col("n") > 0, F.col("doc_id")).alias("rep"))), "members"), same


def links(docs: DataFrame, size: int = 5, percent: int = 75, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, groups): (doc_id, n, h1, h2, rep) per document, verified links (a, b) between classes, and (id, component, size) of linked classes.

    every: verify all pairs that pass the filters, not only those across components; the links are then all links between different texts.
    """
    classes = frequency_classes(frequencies(docs, size))
    signed = stored(signatures(docs, size, percent, classes), "signatures")
    members, same = _members(signed)
    # copies leave; what stays keeps its rows where they are
    copies = stored(members.filter("doc_id <> rep").select("doc_id", "h1", "h2").distinct(), "copies")
    maybe, rest = parted(signed.filter("n > 0 and doc_id is not null"), "doc_id", copies)
    firsts = rest.union(maybe.join(copies.hint("merge"), ["doc_id", "h1", "h2"], "left_anti").select(*rest.columns)).withColumnRenamed("doc_id", "rep")
    firsts = stored(firsts.select("rep", "n", "prefix", "parts"), "firsts")
    discard(signed, copies)
    reps = firsts.select("rep", "n", "parts")
    # shingles that several classes have in their prefixes
    dealt = firsts.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    often = stored(dealt.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"), "often")
    shared = stored(met(parted(dealt, "token", often)[0], often, ["token"]).select("token", "rep", "n", "pos"), "shared")
    first = stored(shared.groupBy("token").agg(F.min(F.struct("rep", "n", "pos")).alias("f"), F.count("*").alias("size")), "pivots")
    star = met(shared, first, ["token"]).select(F.col("f.rep").alias("a"), F.col("rep").alias("b"), F.col("f.n").alias("na"), F.col("n").alias("nb"), F.col("f.pos").alias("pa"), F.col("pos").alias("pb"))
    star = stored(star.filter("a <> b").filter(_keep_sql(percent)).select("a", "b").distinct(), "pairs")
    star = stored(_suffix(star, reps, percent), "pairs")
    linked = stored(verify(star, docs, size, percent), "links")
    # the texts of one document belong together
    own = members.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("doc_id", "a")
    own = stored(members.join(stored(own, "several").hint("merge"), "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "own")
    groups = stored(components(linked.union(own)), "groups")
    # shingles whose classes are in several components yet
    comp = F.col("rep") if every else F.coalesce("component", "rep")
    placed = stored(shared.join(groups.hint("merge"), shared.rep == groups.id, "left").select("token", "rep", "n", "pos", comp.alias("comp")), "placed")
    discard(often, shared, first)
    across = _cross(placed, reps, percent).distinct()
    cross = stored(across.join(star.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "pairs")
    if cross.limit(1).count():
        linked = stored(linked.union(verify(cross, docs, size, percent)), "links")
        groups = components(linked.union(own))
    sizes = same.groupBy("rep").agg(F.sum("size").alias("size"))
    groups = stored(groups.join(sizes.withColumnRenamed("rep", "id").hint("merge"), "id"), "groups")
    return members, linked, groups


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles (set size), component_id (smallest doc_id reachable by links), class_id (smallest doc_id with the same words)."""
    members, _, groups = links(docs, size, percent)
    # a row without words takes the class of another row of its document
    bare = stored(members.filter("n = 0 and doc_id is not null").select(F.col("doc_id").alias("bare")).distinct(), "bare")
    words = parted(members.filter("n > 0 and doc_id is not null"), "doc_id", bare, "bare")[0].join(bare.hint("merge"), F.col("doc_id") == F.col("bare"), "left_semi").groupBy(F.col("doc_id").alias("bare")).agg(F.min("rep").alias("other"))
    empty = members.filter("n = 0").join(words.hint("merge"), F.col("doc_id") == F.col("bare"), "left").select("doc_id", "n", F.col("other").alias("rep"))
    rows = members.filter("n > 0").select("doc_id", "n", "rep").union(empty)
    named = groups.select(F.col("id").alias("rep"), "component", "size")
    maybe, rest = parted(rows, "rep", named)
    out = met(maybe, named, ["rep"], "left").select("doc_id", "n", "rep", "component").union(rest.select("*", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs whose doc_id names their component, with all columns; of repeated rows with that doc_id all stay."""
    found = jaccard_components(docs, size, percent)
    key = fresh(docs, "_gone")
    gone = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    maybe, rest = parted(docs, "doc_id", gone, key)
    return rest.union(maybe.join(gone.hint("merge"), F.col("doc_id") == F.col(key), "left_anti"))
