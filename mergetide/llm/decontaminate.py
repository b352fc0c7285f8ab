"""Benchmark passages in documents, edited ones included.

The CGK embedding walks through a word sequence: at step t it writes the word it stands on, and moves on by one word
if a coin, a keyed hash of t and the word, says so.  Sequences at a small edit distance fall in step again after each
edit, so their embeddings differ in few places.  Each of ``REPEATS`` walks samples ``BITS`` places of the embedding, and
item-sized windows of documents that agree with an item in the sampled places are candidates.  A walk passes about
half a word a step, so places are sampled below twice the item's length.  Candidates are confirmed by the exact
edit distance between the item and the best stretch of the document there.

Walks drift apart with length, so items of twice ``PIECE`` words or more are walked from the start of each of their pieces
of ``PIECE`` to 2 ``PIECE`` words; of an item at the limit, some piece holds no more edits than its share.

A window within k edits of an item keeps ``MARKS`` at least of any k + ``MARKS`` of its words.  So only windows that reach
over that many of the item's k + ``MARKS`` rarest words, counted over all documents, are walked; this loses nothing.

The benchmark is a query set: it is read in blocks of ``BLOCK`` items, whose look-up tables (about 2 KB an item) are made once
and broadcast; a block costs two passes over the documents, one to count its words and one to search.  Edges:
items and texts that are null, empty or without words match nothing; repeated rows and items each give their own
rows; very long texts are walked whole; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.llm.tokens import PUNCTUATION, Words, mix, slices, words_of

BLOCK, REPEATS, BITS, MARKS, PIECE = 100_000, 32, 2, 3, 30
MAP_BITS = 22
SCHEMA = "doc_id long, item_id long, start long, n_words long, n_edits long, distance_limit long"


def normal_words(texts: pa.Array) -> Words:
    """Lower-case words of letters and digits."""
    return words_of(pc.utf8_lower(texts), between=PUNCTUATION)


def places_of(length: int) -> np.ndarray:
    """The sampled places of each walk, for items of about ``length`` words (the lower end of their class)."""
    rng = np.random.default_rng(length)
    return np.array([rng.choice(max(BITS, 2 * length), BITS, replace=False) for _ in range(REPEATS)])


def class_of(length: int) -> int:
    """Lower end of the length class; classes grow by a quarter."""
    low = 1
    while (high := max(low + 1, low * 5 // 4)) <= length:
        low = high
    return low


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each walk (rows) and start (columns) the bucket: a hash of the words at the walk's sampled places (0 past the end)."""
    walks = np.arange(REPEATS, dtype=np.uint64)[:, None]
    keys = np.repeat(walks + np.uint64(1), len(starts), 1)
    at = np.repeat(starts[None, :], REPEATS, 0)
    for t in range(int(places.max()) + 1):
        inside = at < ends
        here = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        taken = (places == t).any(1)
        keys[taken] = mix(keys[taken] * np.uint64(0x9E3779B97F4A7C15) + here[taken])
        coin = mix(here ^ ((walks << np.uint64(32)) + np.uint64(t + 1))) & np.uint64(1)
        at += inside & coin.astype(bool)
    return keys


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Edit distance of ``item`` to its nearest stretch of ``text``, and that stretch (first word, word after the last)."""
    n = len(text)
    far = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), far.copy()
    for i, word in enumerate(item):
        step = np.minimum(cost[:-1] + (text != word), cost[1:] + 1)
        source = np.where(cost[:-1] + (text != word) <= cost[1:] + 1, origin[:-1], origin[1:])
        full, from_ = np.append(i + 1, step), np.append(0, source)
        lead = full - far
        best = np.minimum.accumulate(lead)
        holder = np.maximum.accumulate(np.where(lead == best, far, 0))
        cost, origin = best + far, from_[holder]
    j = int(cost.argmin())
    return int(cost[j]), int(origin[j]), j


class Items:
    """A block of benchmark items and what tasks look up in it."""

    def __init__(self, ids: list[int], texts: list[str], edits: float, known: np.ndarray, counts: np.ndarray) -> None:
        w = normal_words(pa.array(texts, pa.string()))
        self.words = [w.hashes[a:b] for a, b in zip(w.row[:-1], w.row[1:], strict=True)]
        self.ids = ids
        self.size = np.diff(w.row)
        self.limit = (edits * self.size).astype(np.int64)
        self.least = np.minimum(MARKS, self.size - self.limit)
        words, items = [], []
        for i, x in enumerate(self.words):
            often = counts[np.searchsorted(known, x)]
            rarest = np.unique(x[np.argsort(often, kind="stable")[: self.limit[i] + self.least[i]]])
            words.append(rarest)
            items.append(np.full(len(rarest), i))
        words, items = np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *items])
        order = np.argsort(words, kind="stable")
        self.marks, first = np.unique(words[order], return_index=True)
        self.holders, self.first = items[order], np.append(first, len(words))  # items that a marked word stands for
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[self.marks >> np.uint64(64 - MAP_BITS)] = True
        self.pieces = np.maximum(1, self.size // PIECE)
        self.cls = np.array([class_of(n) if n else 0 for n in self.size // self.pieces], np.int64)
        self.places = {c: places_of(c) for c in np.unique(self.cls).tolist() if c}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # keys, their items, words of the item before
        for c, places in self.places.items():
            members = np.flatnonzero(self.cls == c)
            n = self.pieces[members]
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            members = np.repeat(members, n)
            before = number * self.size[members] // self.pieces[members]
            keys = embed(w.hashes, w.row[members] + before, w.row[members + 1], places).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables[c] = keys[order], np.tile(members, REPEATS)[order], np.tile(before, REPEATS)[order]

    def marked(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(item, word of the text) wherever enough of an item's marked words stand within its reach."""
        at = np.flatnonzero(self.map[w.hashes >> np.uint64(64 - MAP_BITS)])
        j = np.minimum(np.searchsorted(self.marks, w.hashes[at]), max(0, len(self.marks) - 1))
        right = self.marks[j] == w.hashes[at] if len(self.marks) else np.zeros(0, bool)
        at, j = at[right], j[right]
        n = self.first[j + 1] - self.first[j]
        item = self.holders[np.repeat(self.first[j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        row = np.searchsorted(w.row, at, "right") - 1
        live = np.zeros(len(at), bool)
        reach = self.size + self.limit
        for least in range(1, MARKS + 1):
            k = np.flatnonzero(self.least[item] == least)
            k = k[k + least <= len(at)]
            z = k + least - 1
            k = k[(item[z] == item[k]) & (row[z] == row[k]) & (at[z] - at[k] < reach[item[k]])]
            for o in range(least):
                live[k + o] = True
        return item[live], at[live]

    def hits(self, w: Words) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, first word, words, edits, limit) of each row's best stretch for each item that it holds."""
        item, at = self.marked(w)
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        reach = self.size + self.limit
        for c in np.unique(self.cls[item]).tolist():
            mine = self.cls[item] == c
            home = np.searchsorted(w.row, at[mine], "right") - 1
            low = np.maximum(at[mine] - reach[item[mine]], w.row[home])
            high = np.where(self.pieces[item[mine]] > 1, np.minimum(at[mine] + reach[item[mine]], w.row[home + 1]), at[mine] + 1)
            edge = np.zeros(len(w.hashes) + 1, np.int64)
            np.add.at(edge, low, 1)
            np.add.at(edge, high, -1)
            every = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            keys, members, before = self.tables[c]
            for starts in (every[i : i + 4096] for i in range(0, len(every), 4096)):
                rows = np.searchsorted(w.row, starts, "right") - 1
                own = embed(w.hashes, starts, w.row[rows + 1], self.places[c])
                a, b = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                for r, s in zip(*np.nonzero(b > a), strict=True):
                    for i, z in set(zip(members[a[r, s] : b[r, s]].tolist(), before[a[r, s] : b[r, s]].tolist(), strict=True)):
                        found[int(rows[s]), i].add(max(int(w.row[rows[s]]), int(starts[s]) - z))
        for (i, item), where in sorted(found.items()):
            best = self.confirm(w, i, item, sorted(where))
            if best:
                yield i, item, best[1] - int(w.row[i]), best[2] - best[1], best[0], int(self.limit[item])

    def confirm(self, w: Words, i: int, item: int, where: list[int]) -> tuple[int, int, int] | None:
        """The least edit distance within the limit around any of the starts, and its stretch."""
        x, k = self.words[item], int(self.limit[item])
        best = None
        a = None
        for s in [*where, None]:  # starts that overlap make one stretch
            if a is not None and (s is None or s - k > b):
                part = w.hashes[a:b]
                if np.isin(x, part).sum() >= len(x) - k:
                    cost, p, q = best_match(x, part)
                    if cost <= k and (best is None or cost < best[0]):
                        best = (cost, a + p, a + q)
                a = None
            if s is not None:
                if a is None:
                    a = max(int(w.row[i]), s - k)
                b = min(int(w.row[i + 1]), s + len(x) + k)
        return best


def word_counts(rows: DataFrame, words: np.ndarray) -> np.ndarray:
    """How often each of ``words`` (sorted) occurs in all texts."""
    if not len(words):
        return np.zeros(0, np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(words)  # of BLOCK items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        total = np.zeros(len(words), np.int64)
        seen = np.zeros(1 << MAP_BITS, bool)
        seen[words >> np.uint64(64 - MAP_BITS)] = True
        for b in slices(batches, "text"):
            h = normal_words(b["text"]).hashes
            h = h[seen[h >> np.uint64(64 - MAP_BITS)]]
            j = np.minimum(np.searchsorted(words, h), len(words) - 1)
            total += np.bincount(j[words[j] == h], minlength=len(words))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    out = np.zeros(len(words), np.int64)
    for r in rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["word"]] = r["n"]
    return out


def blocks_of(rows: DataFrame, benchmark: DataFrame, edits: float, item_id_col: str, item_text_col: str, block: int) -> Iterator[Broadcast[Items]]:
    """The benchmark in blocks, with the counts of their words in all documents."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    ids: list[int] = []
    texts: list[str] = []

    def made() -> Broadcast[Items]:
        words = np.unique(normal_words(pa.array(texts, pa.string())).hashes)
        return rows.sparkSession.sparkContext.broadcast(Items(ids, texts, edits, words, word_counts(rows, words)))

    for r in items.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        if len(ids) == block:
            yield made()
            ids, texts = [], []
    if ids:
        yield made()


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per document and item that it holds within ``edits`` times the item's words of edits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def search(items: Broadcast[Items]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = items.value
            for b in slices(batches, "text"):
                hits = list(known.hits(normal_words(b["text"])))
                if hits:
                    i, item, *rest = map(list, zip(*hits, strict=True))
                    found = [b["doc_id"].take(pa.array(i)), pa.array([known.ids[x] for x in item], pa.int64()), *(pa.array(c, pa.int64()) for c in rest)]
                    yield pa.RecordBatch.from_arrays(found, ["doc_id", "item_id", "start", "n_words", "n_edits", "distance_limit"])

        return rows.mapInArrow(run, SCHEMA)

    found = [search(items) for items in blocks_of(rows, benchmark, edits, item_id_col, item_text_col, block)]
    return reduce(DataFrame.unionByName, found) if found else rows.limit(0).selectExpr("doc_id", *(f"cast(null as {t}) as {c}" for c, t in (x.split() for x in SCHEMA.split(", ")[1:])))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, item_id_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) that hold no item."""

    def drop(left: DataFrame, items: Broadcast[Items]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                keep = np.ones(b.num_rows, bool)
                keep[[h[0] for h in items.value.hits(normal_words(b["text"]))]] = False
                yield b.filter(pa.array(keep))

        return left.mapInArrow(run, docs.schema)

    left = docs
    for items in blocks_of(docs, benchmark, edits, item_id_col, item_text_col, block):
        left = drop(left, items)
    return left
