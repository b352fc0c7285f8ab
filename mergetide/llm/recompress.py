"""Substring deduplication by recompression.

Rounds name token runs, then pairs: a run of one word is one symbol, and in each pair round every symbol falls by a
keyed coin on the left or right side, and a left symbol followed by a right one becomes one symbol.  A name is the
fingerprint of what it stands for, so all tasks give equal runs and pairs equal names without exchanging a dictionary;
equal substrings get the same symbols but for some at their ends.  Which symbols of a window those can be follows from
the window alone: its first and last run, and in each round a first symbol that could join to the left or a last one
that could join to the right.  The longest symbol of the highest level that is certain is the window's key, and windows
that share it are compared by fingerprint (:mod:`mergetide.llm.windows`); a window without certain symbols (a few runs
of one word) is its own key.

Edges: null and empty texts have no words; texts under ``width`` words lose nothing; null ids come before all others;
rows with equal id and text count as one document and get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.llm.tokens import Words, mix, slices, words_of
from mergetide.llm.windows import HOT, LEAST, identified, later_windows, merged
from mergetide.sources.shared import cut

ROUNDS = 5


def range_max(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Maximum of values[low:high] for each pair; all ranges hold something."""
    size = high - low
    out = np.zeros(len(low), values.dtype)
    power, table = 1, values
    while len(table):
        here = (size >= power) & (size < 2 * power)
        if here.any():
            out[here] = np.maximum(table[low[here]], table[high[here] - power])
        if not (size >= 2 * power).any():
            break
        table = np.maximum(table[: len(table) - power], table[power:]) if len(table) > power else table[:0]
        power *= 2
    return out


def symbol_keys(width: int, rounds: int = ROUNDS):
    def keys(w: Words, starts: np.ndarray, prints: np.ndarray) -> np.ndarray:
        n = len(w.hashes)
        first_of_row = np.zeros(n + 1, bool)
        first_of_row[w.row] = True
        # runs of one word; begin: first word of each symbol, and the end of the last
        new = first_of_row[:n].copy()
        new[1:] |= w.hashes[1:] != w.hashes[:-1]
        begin = np.append(np.flatnonzero(new), n)
        size = np.diff(begin).astype(np.uint64)
        names = np.where(size > 1, mix(w.hashes[begin[:-1]] + size), w.hashes[begin[:-1]])
        index = np.cumsum(new) - 1
        # certain symbols of each window are those from low up to high, as numbers of symbols
        low, high = index[starts] + 1, index[starts + width - 1]
        levels = [(names, begin, low, high)]
        for k in range(rounds):
            right = (mix(names + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
            some = low < high
            lo, hi = np.minimum(low, len(names) - 1), np.maximum(high - 1, 0)
            low = low + (some & right[lo])
            high = high - (some & (low < high) & ~right[hi])
            join = np.zeros(len(names) + 1, bool)  # with the symbol before
            join[1:-1] = right[1:] & ~right[:-1] & ~first_of_row[begin[1:-1]]
            lead = np.flatnonzero(~join[:-1])
            paired = join[lead + 1]
            names = np.where(paired, mix(names[lead] * np.uint64(0xD6E8FEB86659FD93) + names[np.minimum(lead + 1, len(names) - 1)] + np.uint64(k)), names[lead])
            fresh = np.cumsum(~join[:-1]) - 1
            begin = np.append(begin[lead], n)
            fresh = np.append(fresh, len(lead))
            low, high = fresh[low], fresh[np.maximum(high, low)]
            levels.append((names, begin, low, high))
        out = mix(prints)
        todo = np.ones(len(starts), bool)
        for k, (names, begin, low, high) in reversed(list(enumerate(levels))):
            some = np.flatnonzero(todo & (low < high))
            if len(some):
                rank = (np.minimum(np.diff(begin), 255).astype(np.uint64) << np.uint64(56)) | (names >> np.uint64(8))
                out[some] = mix(range_max(rank, low[some], high[some]) + np.uint64(k))
                todo[some] = False
        return out

    return keys


def dedup_substrings(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of each row: words of windows that also start earlier are removed.

    hot: how many windows of a bucket of keys one task may get.
    """
    rows = identified(docs, id_col, text_col)
    found = later_windows(rows, width, symbol_keys(width), hot)
    spans = cut(found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    joined = rows.join(spans, ["doc_id", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words_of(b["text"])
            text = w.data.tobytes()
            removed, kept = [], []
            for i, spans in enumerate(b["spans"].to_pylist()):
                a, z = int(w.row[i]), int(w.row[i + 1])
                stretches = merged([(s["start"], s["stop"]) for s in spans or ()])
                pieces, at = [], a
                for s, t in [*((a + s, a + t) for s, t in stretches), (z, z)]:
                    pieces += [text[p:q] for p, q in zip(w.starts[at:s].tolist(), w.ends[at:s].tolist(), strict=True)]
                    at = t
                kept.append(b" ".join(pieces).decode())
                removed.append(sum(t - s for s, t in stretches))
            ids = pa.array([None if x == LEAST else x for x in b["doc_id"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(w.row)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
