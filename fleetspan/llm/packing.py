"""Best-fit packing into bins of several permitted sequence lengths.

A document is one item as long as its words, or, beyond the largest length, pieces of that length and a rest. Items are dealt by hash to
shards of some SHARD rows, and each shard is packed on its own, longest items first: an item goes to the open bin in which it leaves the
least room; if none has room, a bin is opened, of the length that costs least a token when filled from what is still to come. A bin
costs its length and OVERHEAD. As a shard's best choice depends on which lengths are opened at all, each largest length allowed is tried, and
the cheapest packing is taken. At last every bin is downsized to the least permitted length that holds its contents.

Defined results: null and empty texts have one piece of length 0, in no bin (null bin_id). Rows that repeat are packed one by one. Null doc_ids
are dealt by their text's length. Repeats of one doc_id, however many, are spread over all shards. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import stored

LENGTHS = (256, 512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD = 4096


def lengths_of(docs: DataFrame) -> DataFrame:
    """doc_id and length (words of the whole text)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tk.word_counts(batch.column(1)), pa.int64())], ["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, length long")


def pieces_of(items: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece (from 0), start and n: pieces of largest words, and the rest."""
    last = F.greatest(F.lit(0), F.ceil(F.col("length") / largest).cast("long") - 1)
    return items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("start", F.col("piece") * largest).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", F.least(F.lit(largest).cast("long"), F.col("length") - F.col("start")).alias("n"))


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...], overhead: int) -> tuple[np.ndarray, list[int]]:
    """(bin of each item, capacity of each bin). sizes: descending, between 1 and the greatest of lengths."""
    rooms: list[int] = []  # distinct rooms left, ascending
    bins: dict[int, list[int]] = {}  # open bins by room left
    left = np.cumsum(sizes[::-1])[::-1]  # words from this item on
    capacity: list[int] = []
    put = np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        k = bisect.bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[k]
        else:
            rest = int(left[i])
            fits = [c for c in lengths if c >= s]
            room = min(fits, key=lambda c: ((c + overhead) / min(c, rest), c))
            b = len(capacity)
            capacity.append(room)
        put[i] = b
        room -= s
        if room:
            if room in bins:
                bins[room].append(b)
            else:
                bins[room] = [b]
                bisect.insort(rooms, room)
    return put, capacity


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD):
    """(bin, offset in it and its capacity by item) of the cheapest packing over the choices of the largest length opened, bins downsized."""
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    down = sizes[order]
    best = None
    for top in [c for c in lengths if not len(down) or c >= down[0]]:
        put, capacity = best_fit(down, tuple(c for c in lengths if c <= top), overhead)
        used = np.bincount(put, down, minlength=len(capacity)).astype(np.int64)
        final = np.array(lengths)[np.searchsorted(lengths, used)]
        cost = int(final.sum()) + overhead * len(final)
        if best is None or cost < best[0]:
            best = cost, put, final
    _, put, final = best
    by_bin = np.argsort(put, kind="stable")
    run = np.cumsum(down[by_bin]) - down[by_bin]
    firsts = np.append(True, put[by_bin][1:] != put[by_bin][:-1]) if len(put) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(firsts, run, 0))
    offset = np.empty(len(put), dtype=np.int64)
    offset[by_bin] = run - base
    out = np.empty((3, len(sizes)), dtype=np.int64)
    out[0, order], out[1, order], out[2, order] = put, offset, final[put] if len(put) else 0
    return out


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start (word), n_tokens, bin_id, bin_capacity, bin_offset."""
    items = stored(pieces_of(lengths_of(docs), max(lengths)), "pieces")
    shards = max(1, math.ceil(items.count() / shard))
    # repeats of one doc_id are spread as well: the piece and its length take part
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def run(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("n", "ascending")])
        n = table.column("n").to_numpy()
        solid = n > 0
        bins, offs, caps = np.zeros((3, len(n)), dtype=np.int64)
        bins[solid], offs[solid], caps[solid] = pack(n[solid], lengths, overhead) if solid.any() else np.zeros((3, 0), np.int64)
        gone = ~solid
        ids = (np.int64(key[0].as_py()) << 32) + bins
        return pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": table.column("start"), "n_tokens": table.column("n"), "bin_id": pa.array(ids, mask=gone), "bin_capacity": pa.array(caps, mask=gone), "bin_offset": pa.array(offs, mask=gone)})

    return items.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_capacity long, bin_offset long")
