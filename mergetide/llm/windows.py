"""Repeated word windows: one shuffle of window fingerprints, grouped by a key that a window's words alone decide.

A map task gives each window of ``width`` words a key (such as a recompression symbol inside it) and writes one row for
each stretch of consecutive windows of a document with one key: document, first word, and 64 bits of each window's
fingerprint.  Equal windows have equal keys, so a task that reads the rows of a key in order of document and position
finds each window's first occurrence; it keeps only distinct windows of the one key it is reading.

A passage shorter than ``width`` that many documents hold gives all its windows one key, and most of these windows differ;
a passage that is longer gives many equal windows.  So windows are counted first in ``BUCKETS`` buckets of keys, and those in
buckets with more than ``hot`` (and more than 8 times the mean) go another way: a row each, whose first occurrence is an
aggregate that combines before the shuffle, and which come back to it by a join whose skewed keys the engine splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.llm.tokens import Words, mix, rolling, slices, spans_of, words_of
from mergetide.sources.shared import cut

BYTES, BUCKETS, HOT = 8, 1 << 16, 1 << 16
LEAST = np.int64(-(2**63))
#: (Words, starts of windows) -> a key for each window
Keys = Callable[[Words, np.ndarray, np.ndarray], np.ndarray]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, tag, text``; tag tells apart rows that share an id but not a text.  Null ids count as the smallest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LEAST))).alias("doc_id"), F.hash(text).alias("tag"), text.alias("text"))


def bucket_of(key: np.ndarray) -> np.ndarray:
    return (mix(key) % np.uint64(BUCKETS)).astype(np.int64)


def with_firsts(rows: DataFrame, content: list[str], place: list[str], kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of ``rows(*content, doc_id, tag, *place)``, a written table.

    Classes are the distinct contents with their ``first`` place, a struct of ``doc_id, tag, *place``, and the columns of
    ``kept``; members are the rows of contents that stand at two places at least, with ``later``: not the first one.
    """
    at = F.struct("doc_id", "tag", *place)
    classes = rows.groupBy(*content, *(kept or [])).agg(F.min(at).alias("first"), F.max(at).alias("_last"))
    classes = cut(classes.withColumn("twice", F.col("first") != F.col("_last")).drop("_last"), "classes")
    members = rows.join(classes.where("twice").select(*content, "first"), content).withColumn("later", at > F.col("first"))
    return classes.drop("twice"), members.drop("first")


def hot_buckets(docs: DataFrame, width: int, keys: Keys, most: int = HOT) -> np.ndarray:
    """Whether a bucket of keys holds too many windows for one task: more than ``most``, and more than 1 in 8192 of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in slices(batches, "text"):
            w = words_of(b["text"])
            starts, _ = spans_of(w.row, width)
            if len(starts):
                total += np.bincount(bucket_of(keys(w, starts, rolling(w.hashes, width)[starts])), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in found.toLocalIterator():  # as many rows as buckets
        counts[r["bucket"]] = r["n"]
    return counts > max(most, 8 * int(counts.sum()) // BUCKETS)


def window_rows(docs: DataFrame, width: int, keys: Keys, hot: np.ndarray) -> DataFrame:
    """``key, doc_id, tag, start, prints``: stretches of windows of one document that share a key, hot ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words_of(b["text"])
            starts, rows = spans_of(w.row, width)
            prints = rolling(w.hashes, width)[starts]
            key = keys(w, starts, prints) if len(starts) else prints
            cold = ~hot[bucket_of(key)]
            starts, rows, prints, key = starts[cold], rows[cold], prints[cold], key[cold]
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)
            at = np.flatnonzero(new)
            offsets = np.append(at, len(starts)) * BYTES
            blob = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(prints.astype("<u8")))])
            r = rows[at]
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), b["doc_id"].take(pa.array(r)), b["tag"].take(pa.array(r)), pa.array((starts[at] - w.row[r]).astype(np.int32)), blob], ["key", "doc_id", "tag", "start", "prints"])

    return docs.mapInArrow(run, "key long, doc_id long, tag int, start int, prints binary")


def hot_windows(docs: DataFrame, width: int, keys: Keys, hot: np.ndarray) -> DataFrame:
    """``key, print, doc_id, tag, start``: the windows with hot keys, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words_of(b["text"])
            starts, rows = spans_of(w.row, width)
            if not len(starts):
                continue
            prints = rolling(w.hashes, width)[starts]
            key = keys(w, starts, prints)
            i = np.flatnonzero(hot[bucket_of(key)])
            r = rows[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[i].view(np.int64)), pa.array(prints[i].view(np.int64)), b["doc_id"].take(pa.array(r)), b["tag"].take(pa.array(r)), pa.array((starts[i] - w.row[r]).astype(np.int32))],
                ["key", "print", "doc_id", "tag", "start"],
            )

    return docs.mapInArrow(run, "key long, print long, doc_id long, tag int, start int")


def later_windows(docs: DataFrame, width: int, keys: Keys, most: int = HOT) -> DataFrame:
    """``doc_id, tag, start, stop``: words covered by windows that occur before."""
    hot = hot_buckets(docs, width, keys, most)
    found = repeats(window_rows(docs, width, keys, hot), width)
    if not hot.any():
        return found
    members = with_firsts(cut(hot_windows(docs, width, keys, hot), "hot"), ["key", "print"], ["start"])[1]
    return found.unionByName(members.where("later").select("doc_id", "tag", "start", (F.col("start") + width).alias("stop")))


def repeats(rows: DataFrame, width: int) -> DataFrame:
    """``doc_id, tag, start, stop``: words covered by windows that occur before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)  # sorted: distinct windows so far of the key being read
        open_key = before = None
        for b in batches:
            key = b["key"].to_numpy()
            doc, tag, start = (b[c].to_numpy().astype(np.int64) for c in ("doc_id", "tag", "start"))
            offsets = np.frombuffer(b["prints"].buffers()[1], np.int32)[b["prints"].offset :][: len(key) + 1]
            sizes = np.diff(offsets) // BYTES
            twin = np.zeros(len(key), bool)  # the same row of documents again
            twin[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] == start[:-1])
            twin[0] = before == (key[0], doc[0], tag[0], start[0])
            before = (key[-1], doc[-1], tag[-1], start[-1])
            r = np.repeat(np.arange(len(key)), sizes)
            at = start[r] + np.arange(len(r)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            raw = np.frombuffer(b["prints"].buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            one = mix(np.frombuffer(raw.tobytes(), "<u8").astype(np.uint64) + mix(key.view(np.uint64))[r])
            live = ~twin[r]
            r, at, one = r[live], at[live], one[live]
            order = np.argsort(one, kind="stable")
            s = one[order]
            head = np.ones(len(s), bool)
            head[1:] = s[1:] != s[:-1]
            lead = order[head]  # first in this batch
            known = np.zeros(len(lead), bool)
            if len(seen) and len(key) and open_key == key[0]:
                where = np.minimum(np.searchsorted(seen, one[lead]), len(seen) - 1)
                known = seen[where] == one[lead]
            again = np.zeros(len(one), bool)
            again[order] = ~head | known[np.cumsum(head) - 1]
            yield from runs(doc[r[again]], tag[r[again]], at[again], width)
            fresh = lead[~known]
            fresh = np.sort(one[fresh[key[r[fresh]] == key[-1]]])
            seen = np.sort(np.concatenate([seen, fresh])) if open_key == key[-1] and len(seen) else fresh
            open_key = key[-1]

    ordered = rows.repartition("key").sortWithinPartitions("key", "doc_id", "tag", "start")
    return ordered.mapInArrow(run, "doc_id long, tag int, start int, stop int")


def runs(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Consecutive windows as one stretch of words."""
    if not len(doc):
        return
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != at[:-1] + 1)
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(doc)) - 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[i]), pa.array(tag[i].astype(np.int32)), pa.array(at[i].astype(np.int32)), pa.array((at[j] + width).astype(np.int32))],
        ["doc_id", "tag", "start", "stop"],
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching stretches as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
