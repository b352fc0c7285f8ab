"""Repeated passages by sparse suffix arrays.

Of each document the suffixes are retained that begin at minimisers: the leftmost place of the smallest fingerprint of
``gram`` words in some window of ``width`` words.  A window chooses its place by its own words alone, so equal windows
choose alike, and consecutive windows mostly share a place: a retained suffix stands for its reach, the words from the
first window that chose it to the end of the last one.  About one suffix in ``(width - gram + 2) / 2`` words is retained.

1. Suffixes with the same leading ``gram`` words are brought together (in classes, not in order); those alone in theirs are done.
2. Neighbours are compared over their whole reach, as far to the left and to the right as any window goes.  Suffixes that
   agree form a class; of a class all windows are repeated, and all but its first suffix can go.
3. The first suffixes of classes that share the leading words but not the whole reach (the two ends of a repeated passage,
   mostly) are extended from the shared words to the left and to the right: each window of their reach, built from its words
   again, is compared with those of the other classes.

Comparing is Spark's: classes are aggregates that combine before the shuffle, so a passage that many documents
share costs one row a map task, and their members come back by a join whose skewed keys the engine splits.  No task
holds the suffixes of one passage.  Contents are compared as two 64-bit fingerprints together, of the leading words and of
the reach or window; words themselves are not compared.

Every repeat of at least ``width`` words is found whole, its first occurrence too.  Edges: null and empty texts, and texts
under ``width`` words, hold no repeats; null ids come before all others; rows with equal id and text count as one
document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.llm.tokens import mix, rolling, slices, spans_of, words_of
from mergetide.llm.windows import LEAST, identified, merged, with_firsts
from mergetide.sources.shared import cut


def minimisers(grams: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """For each start the leftmost place of the least of ``reach`` fingerprints from there."""
    at, size = np.arange(len(grams)), 1
    while size * 2 <= reach:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(grams[a] <= grams[b], a, b)
        size *= 2
    a, b = at[starts], at[starts + reach - size]
    return np.where(grams[a] <= grams[b], a, b)


def retained_suffixes(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``gram, print, doc_id, tag, start, last``: fingerprints of the leading words and of the reach; its first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words_of(b["text"])
            starts, rows = spans_of(w.row, width)
            if not len(starts):
                continue
            grams, prints = rolling(w.hashes, gram), rolling(w.hashes, width)
            place = minimisers(grams, starts, width - gram + 1)
            new = np.ones(len(starts), bool)
            new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
            i = np.flatnonzero(new)
            j = np.append(i[1:], len(starts)) - 1
            first, last, at = starts[i], starts[j], place[i]
            # the first and the last window overlap, so that both together are the whole reach
            reach = mix(prints[first] * np.uint64(0xD6E8FEB86659FD93) + prints[last])
            reach = mix(reach + (last - first).astype(np.uint64) * np.uint64(256) + (at - first).astype(np.uint64))
            r = pa.array(rows[i])
            own = w.row[rows[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[at].view(np.int64)), pa.array(reach.view(np.int64)), b["doc_id"].take(r), b["tag"].take(r), pa.array((first - own).astype(np.int32)), pa.array((last - own).astype(np.int32))],
                ["gram", "print", "doc_id", "tag", "start", "last"],
            )

    return docs.mapInArrow(run, "gram long, print long, doc_id long, tag int, start int, last int")


def extended(docs: DataFrame, suffixes: DataFrame, width: int) -> DataFrame:
    """``gram, print, doc_id, tag, start``: the windows in the reach of ``suffixes``, from the words of their documents."""
    lists = suffixes.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("gram", "start", "last")).alias("found"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words_of(b["text"])
            prints = rolling(w.hashes, width)
            found = b["found"]
            low, high = (found.offsets.to_numpy()[k : k + b.num_rows] for k in (0, 1))
            rows = np.repeat(np.arange(b.num_rows), high - low)
            grams, first, last = (found.values.field(c).to_numpy()[low[0] : high[-1]] for c in ("gram", "start", "last"))
            n = last.astype(np.int64) - first + 1
            each = np.repeat(np.arange(len(n)), n)
            start = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            r = rows[each]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[each]), pa.array(prints[start + w.row[r]].view(np.int64)), b["doc_id"].take(pa.array(r)), b["tag"].take(pa.array(r)), pa.array(start.astype(np.int32))],
                ["gram", "print", "doc_id", "tag", "start"],
            )

    return docs.join(lists, ["doc_id", "tag"]).mapInArrow(run, "gram long, print long, doc_id long, tag int, start int")


def repeated_spans(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``doc_id, tag, first, start, stop``: words of windows that occur elsewhere; ``first`` where none of them is earlier."""
    suffixes = cut(retained_suffixes(docs, width, gram), "suffixes")
    heads = suffixes.groupBy("gram").agg(F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b"))
    heads = cut(heads.where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("forked")), "heads")
    shared = cut(suffixes.join(heads, "gram"), "shared")
    classes, members = with_firsts(shared, ["gram", "print"], ["start", "last"], ["forked"])
    whole = members.select("doc_id", "tag", (~F.col("later")).alias("first"), "start", (F.col("last") + width).alias("stop"))
    ends = cut(extended(docs, classes.where("forked").select("gram", "first.doc_id", "first.tag", "first.start", "first.last"), width), "windows")
    parts = with_firsts(ends, ["gram", "print"], ["start"])[1]
    return whole.unionByName(parts.select("doc_id", "tag", (~F.col("later")).alias("first"), "start", (F.col("start") + width).alias("stop")))


def repeated_passages(docs: DataFrame, width: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a repeat: all repeated stretches, and those that occur earlier in the table.

    ``doc_id, n_repeated, n_removable`` (words), ``spans, removable`` (arrays of first word and word after the last).
    """
    found = repeated_spans(identified(docs, id_col, text_col), width, gram)
    spans = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "start", "stop")).alias("found"))

    @F.pandas_udf("spans array<struct<start:int,stop:int>>, removable array<struct<start:int,stop:int>>")
    def join_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for found in batch:
                every = [(int(s["start"]), int(s["stop"]), bool(s["first"])) for s in found]
                pick = [merged([(a, b) for a, b, _ in every]), merged([(a, b) for a, b, first in every if not first])]
                rows.append([[{"start": a, "stop": b} for a, b in x] for x in pick])
            yield pd.DataFrame(rows, columns=["spans", "removable"])

    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    out = spans.withColumn("j", join_up("found"))
    return out.select(
        F.nullif(F.col("doc_id"), F.lit(int(LEAST))).alias("doc_id"), total(F.col("j.spans")).alias("n_repeated"), total(F.col("j.removable")).alias("n_removable"),
        F.col("j.spans").alias("spans"), F.col("j.removable").alias("removable"),
    )
