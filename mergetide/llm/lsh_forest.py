"""Near-duplicate documents by a MinHash LSH forest, confirmed on full shingle sets.

Documents with equal sets are one class from the start.  Each tree sorts the signatures in an order of lanes of its
own.  Neighbours with a common prefix of at least ``DEPTH`` lanes are candidates; a region that holds more than
``LEAF`` signatures is cut by further lanes, so that depth grows where the signatures are dense.  A region that
cannot be cut (its signatures agree on ten lanes) is read in blocks, and each block is compared with the one before
and with the region's first.  Candidates whose signatures agree too little are passed over (chance for a pair at
the threshold: 2e-5), and after the first round those whose sets, counted in ``BINS`` bins by hash, cannot have enough in
common; the others are confirmed on their sets.

Three rounds: first every signature with its best candidates, then - with the components known - all candidate pairs
between different components that were not yet confirmed or refused.  Links inside a component change nothing.
The third makes up for what cuts and blocks left out: in each region over ``LEAF`` signatures at depth 3, all that are
not of its largest component are compared with all of it, in salted pairs of blocks dealt over the tasks.  So every two
signatures of different components that share a region at depth 3 are compared, however large it is; a pair at
similarity 0.8 misses all ``TREES`` trees of depth 3 with chance 1e-5.  The work of the third round is the size of a
region times the signatures outside its largest component.

Edges: null, empty and wordless texts have an empty set and link with nothing; texts under ``k`` words are one
shingle; rows that share an id are one document; rows without an id link with nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.llm.components import components
from mergetide.llm.tokens import Words, mix, rolling, slices, spans_of, words_of
from mergetide.sources.shared import cut, free

LANES, TREES, DEPTH, LEAF, BLOCK, BINS = 128, 16, 3, 512, 1024, 256
BITS = 4  # of each lane in a sketch; lanes that differ agree in them by chance, which the bounds count in
ODD = mix(np.arange(1, LANES + 1, dtype=np.uint64)) | np.uint64(1)
PLUS = mix(np.arange(1001, 1001 + LANES, dtype=np.uint64))


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, each row's sorted, and the first of each row (one more at the end)."""
    prints = rolling(w.hashes, k)
    starts, rows = spans_of(w.row, k)
    counts = np.bincount(rows, minlength=len(w.row) - 1)
    at = np.append(0, np.cumsum(counts))
    values = prints[starts]
    sets, none = [], np.zeros(0, np.uint64)
    for i, n in enumerate(np.diff(w.row).tolist()):
        if n >= k:
            sets.append(np.unique(values[at[i] : at[i + 1]]))
        elif n:
            own = w.hashes[w.row[i] : w.row[i + 1]]
            sets.append(mix(rolling(own, n) + np.uint64(n)))
        else:
            sets.append(none)
    return np.concatenate(sets) if sets else none, np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, set_id, lanes, bins``: set size, fingerprint of the set, its MinHash lanes (4 bytes each), its bins' counts (a byte each, at most 255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, at = shingle_sets(words_of(b["text"], lower=True), k)
            n = np.diff(at)
            full = np.flatnonzero(n)
            lanes = np.zeros((b.num_rows, LANES), np.uint32)
            ids = np.zeros(b.num_rows, np.uint64)
            if len(full):
                ids[full] = np.add.reduceat(mix(values + np.uint64(7)), at[:-1][full])
                for j in range(LANES):
                    lanes[full, j] = np.minimum.reduceat(values * ODD[j] + PLUS[j], at[:-1][full]) >> np.uint64(32)
            bins = np.bincount(np.repeat(np.arange(b.num_rows), n) * BINS + (values >> np.uint64(56)).astype(np.int64), minlength=b.num_rows * BINS)
            bins = np.minimum(bins, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(ids.view(np.int64)), blobs(lanes.view(np.uint8)), blobs(bins.reshape(-1, BINS))], ["doc_id", "n", "set_id", "lanes", "bins"])

    return docs.mapInArrow(run, "doc_id long, n long, set_id long, lanes binary, bins binary")


def blobs(x: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def packed(lanes: np.ndarray) -> np.ndarray:
    """Sketch of each signature: the low ``BITS`` bits of each lane, two lanes a byte."""
    low = (lanes & ((1 << BITS) - 1)).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << BITS)


def unpacked(sketch: np.ndarray) -> np.ndarray:
    """A byte for each lane of a sketch."""
    out = np.empty((len(sketch), LANES), np.uint8)
    out[:, ::2], out[:, 1::2] = sketch & ((1 << BITS) - 1), sketch >> BITS
    return out


def tree_keys(lanes: np.ndarray) -> np.ndarray:
    """For each tree (rows) the prefix of each signature (columns)."""
    keys = np.repeat(np.arange(TREES, dtype=np.uint64)[:, None], len(lanes), 1)
    for t in range(TREES):
        for j in range(DEPTH):
            keys[t] = mix(keys[t] * ODD[j] + lanes[:, t * DEPTH + j])
    return keys


def tree_rows(reps: DataFrame) -> DataFrame:
    """``tree_key, rest, doc_id, n, comp, sketch, bins`` for each signature and tree: prefix of the order, its next lanes, its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 1024) for i in range(0, big.num_rows, 1024)):
                lanes = np.frombuffer(b"".join(b["lanes"].to_pylist()), np.uint32).reshape(-1, LANES)
                low = np.ascontiguousarray((lanes & 255).astype(np.uint8))
                blob = blobs(packed(lanes))
                for t, key in enumerate(tree_keys(lanes)):
                    turn = [(TREES * DEPTH + 5 * t + i) % LANES for i in range(7)]
                    rest = np.zeros(len(low), np.int64)
                    for j in turn:
                        rest = rest * 256 + low[:, j]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rest), b["doc_id"], b["n"], b["comp"], blob, b["bins"]], ["tree_key", "rest", "doc_id", "n", "comp", "sketch", "bins"])

    return reps.mapInArrow(run, "tree_key long, rest long, doc_id long, n long, comp long, sketch binary, bins binary")


def leaves(rest: np.ndarray, low: int, high: int, leaf: int, depth: int = 0) -> Iterator[tuple[int, int]]:
    """Regions of at most ``leaf`` signatures, or such that no lane is left to cut by."""
    if high - low <= leaf or depth == 7:
        yield low, high
        return
    lane = (rest[low:high] >> (8 * (6 - depth))) & 255
    edges = [low, *(low + 1 + np.flatnonzero(lane[1:] != lane[:-1])).tolist(), high]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            yield from leaves(rest, a, b, leaf, depth + 1)


def bounds(threshold: int) -> tuple[int, int]:
    """Lanes whose sketches agree at least in candidates at the threshold, and in a clear candidate."""
    share = threshold / 100
    share += (1 - share) / (1 << BITS)
    deviation = (share * (1 - share) / LANES) ** 0.5
    return int(LANES * (share - 4.1 * deviation)), int(LANES * (share - 1.5 * deviation))


def pairs(x: dict[str, np.ndarray], y: dict[str, np.ndarray], same: bool, threshold: int, low: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates between two blocks (``same``: within one) with the lanes they agree on; every: those of different ``comp``."""
    for i in range(len(x["doc"])):
        o = slice(i + 1 if same else 0, None)
        ok = (np.minimum(x["n"][i], y["n"][o]) * 100 >= threshold * np.maximum(x["n"][i], y["n"][o])) & (x["doc"][i] != y["doc"][o])
        if every:
            ok &= x["comp"][i] != y["comp"][o]
        j = np.flatnonzero(ok)
        if len(j):
            j += i + 1 if same else 0
            agree = (y["sketch"][j] == x["sketch"][i]).sum(1)
            hit = agree >= low
            if every and hit.any():
                k = np.flatnonzero(hit)
                common = np.minimum(y["bins"][j[k]], x["bins"][i]).sum(1, dtype=np.int64)
                enough = common * (100 + threshold) >= threshold * (x["n"][i] + y["n"][j[k]])
                hit[k] = enough | y["full"][j[k]] | x["full"][i]
            if hit.any():
                yield np.stack([np.full(hit.sum(), x["doc"][i]), y["doc"][j[hit]], agree[hit]])


def read(b: pa.RecordBatch, every: bool) -> dict[str, np.ndarray]:
    """Columns of a batch of tree rows."""
    more = {"rest": b["rest"].to_numpy()} if "rest" in b.schema.names else {}
    if every:
        more["bins"] = np.frombuffer(b["bins"].buffers()[2], np.uint8)[b["bins"].offset * BINS :][: b.num_rows * BINS].reshape(-1, BINS)
        more["full"] = (more["bins"] == 255).any(1)  # a count that may be higher says nothing
    size = LANES * BITS // 8
    sketch = unpacked(np.frombuffer(b["sketch"].buffers()[2], np.uint8)[b["sketch"].offset * size :][: b.num_rows * size].reshape(-1, size))
    return {"key": b["tree_key"].to_numpy(), "doc": b["doc_id"].to_numpy(), "n": b["n"].to_numpy(), "comp": b["comp"].to_numpy(), "sketch": sketch} | more


def candidates(reps: DataFrame, threshold: int, every: bool, leaf: int) -> DataFrame:
    """``a, b`` (a < b): candidate pairs.

    every: all between different ``comp``; else for each signature its smallest id among clear candidates, or the one
    that agrees best.
    """
    low, clear = bounds(threshold)

    def compare(x: dict[str, np.ndarray], y: dict[str, np.ndarray] | None = None) -> np.ndarray:
        found = list(pairs(x, x if y is None else y, y is None, threshold, low, every))
        if not found:
            return np.zeros((2, 0), np.int64)
        p = np.concatenate(found, axis=1)
        if every:
            return np.stack([np.minimum(p[0], p[1]), np.maximum(p[0], p[1])])
        p = np.concatenate([p, p[[1, 0, 2]]], axis=1)  # each end's view
        rank = np.where(p[2] >= clear, 0, LANES + 1 - p[2])
        order = np.lexsort((p[1], rank, p[0]))
        p = p[:, order]
        first = np.ones(p.shape[1], bool)
        first[1:] = p[0, 1:] != p[0, :-1]
        p = p[:, first]
        return np.unique(np.stack([np.minimum(p[0], p[1]), np.maximum(p[0], p[1])]), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        anchor: dict[str, np.ndarray] | None = None  # first block of a region that cannot be cut
        out: list[np.ndarray] = []

        def emit() -> Iterator[pa.RecordBatch]:
            if out:
                p = np.unique(np.concatenate(out, axis=1), axis=1)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])

        def region(x: dict[str, np.ndarray]) -> None:
            part = lambda a, b: {k: v[a:b] for k, v in x.items()}
            for a, b in leaves(x["rest"], 0, len(x["doc"]), leaf):
                blocks = [part(i, min(b, i + leaf)) for i in range(a, b, leaf)]
                for i, block in enumerate(blocks):
                    out.append(compare(block))
                    if i:
                        out.append(compare(blocks[i - 1], block))
                    if i > 1:
                        out.append(compare(blocks[0], block))

        for b in batches:
            x = read(b, every)
            if held is not None:
                x = {k: np.concatenate([held[k], v]) for k, v in x.items()}
            new = np.flatnonzero(x["key"][1:] != x["key"][:-1]) + 1
            edges = [0, *new.tolist()]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if j - i > 1:
                    region({k: v[i:j] for k, v in x.items()})
                    anchor = None
            held = {k: v[edges[-1] :] for k, v in x.items()}
            if len(held["doc"]) > 64 * leaf:  # a very large region: what is read so far goes, a block stays
                if anchor is not None:
                    out.extend(compare(anchor, {k: v[i : i + leaf] for k, v in held.items()}) for i in range(0, len(held["doc"]), leaf))
                else:
                    anchor = {k: v[:leaf] for k, v in held.items()}
                region(held)
                held = {k: v[-leaf:] for k, v in held.items()}
            yield from emit()
        if held is not None and len(held["doc"]) > 1:
            region(held)
        yield from emit()

    return tree_rows(reps).repartition("tree_key").sortWithinPartitions("tree_key", "rest", "doc_id").mapInArrow(run, "a long, b long").distinct()


def keyed(reps: DataFrame) -> DataFrame:
    """``tree_key, doc_id, comp`` for each signature and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 4096) for i in range(0, big.num_rows, 4096)):
                keys = tree_keys(np.frombuffer(b"".join(b["lanes"].to_pylist()), np.uint32).reshape(-1, LANES))
                every = [np.tile(b[c].to_numpy(), TREES) for c in ("doc_id", "comp")]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *map(pa.array, every)], ["tree_key", "doc_id", "comp"])

    return reps.select("lanes", "doc_id", "comp").mapInArrow(run, "tree_key long, doc_id long, comp long")


def dense_regions(keys: DataFrame, leaf: int) -> DataFrame:
    """``tree_key, major, size, others``: regions over ``leaf`` signatures, their largest component, and the signatures outside it."""
    shares = keys.groupBy("tree_key", "comp").agg(F.count("*").alias("n"))
    regions = shares.groupBy("tree_key").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("others"))
    return regions.where((F.col("size") > leaf) & (F.col("others") > 0))


def sketched(reps: DataFrame) -> DataFrame:
    """``doc_id, n, sketch, bins`` of each signature: its set's size, its sketch, its bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 1024) for i in range(0, big.num_rows, 1024)):
                lanes = np.frombuffer(b"".join(b["lanes"].to_pylist()), np.uint32).reshape(-1, LANES)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["n"], blobs(packed(lanes)), b["bins"]], ["doc_id", "n", "sketch", "bins"])

    return reps.select("doc_id", "n", "lanes", "bins").mapInArrow(run, "doc_id long, n long, sketch binary, bins binary")


def dense_candidates(reps: DataFrame, keys: DataFrame, regions: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """``a, b`` (a < b): all candidate pairs between different ``comp`` in ``regions``, by salted pairs of blocks."""
    low, _ = bounds(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # the block of others being read
        open_ = None
        for big in batches:
            for b in (big.slice(i, block) for i in range(0, big.num_rows, block)):
                x = read(b, True) | {c: b[c].to_numpy() for c in ("i", "j", "whole")}
                new = (x["key"][1:] != x["key"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])
                edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
                out = []
                for p, q in zip(edges[:-1], edges[1:], strict=True):
                    part = {k: v[p:q] for k, v in x.items()}
                    if open_ != (part["key"][0], part["i"][0], part["j"][0]):
                        held, open_ = None, (part["key"][0], part["i"][0], part["j"][0])
                    m = int(np.searchsorted(part["whole"], 1))
                    if m:
                        own = {k: v[:m] for k, v in part.items()}
                        held = own if held is None else {k: np.concatenate([held[k], v]) for k, v in own.items()}
                    if held is not None and m < q - p:
                        out.extend(pairs(held, {k: v[m:] for k, v in part.items()}, False, threshold, low, True))
                if out:
                    f = np.concatenate(out, axis=1)
                    f = np.unique(np.stack([np.minimum(f[0], f[1]), np.maximum(f[0], f[1])]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(f[0]), pa.array(f[1])], ["a", "b"])

    inside = cut(keys.join(regions, "tree_key"), "inside")  # only these rows get their sketches
    rows = inside.join(sketched(reps).join(inside.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    across, down = F.ceil(F.col("size") / block).cast("int"), F.ceil(F.col("others") / block).cast("int")
    salt = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["tree_key", "doc_id", "n", "comp", "sketch", "bins"]
    others = rows.where("comp <> major").select(*columns, salt(down).alias("i"), every(across).alias("j"), F.lit(0).alias("whole"))
    whole = rows.select(*columns, every(down).alias("i"), salt(across).alias("j"), F.lit(1).alias("whole"))
    both = others.unionByName(whole).repartition("tree_key", "i", "j").sortWithinPartitions("tree_key", "i", "j", "whole")
    return both.mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """``a, b, linked`` of pairs, by their full sets."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in batches:
            for b in slices(iter([c]), "text_a", 1 << 19):
                x, at = shingle_sets(words_of(b["text_a"], lower=True), k)
                linked = []
                for i in range(b.num_rows):
                    y, _ = shingle_sets(words_of(b["text_b"].slice(i, 1), lower=True), k)
                    own = x[at[i] : at[i + 1]]
                    common = len(np.intersect1d(own, y, assume_unique=True))
                    linked.append(100 * common >= threshold * (len(own) + len(y) - common))
                yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; threshold: similarity in hundredths.

    leaf: signatures of a region that are compared at once; block: those of a side of a salted pair of blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = cut(signatures(rows, k), "signatures")
    classes = found.where("n > 0 and doc_id is not null").groupBy("n", "set_id").agg(F.min("doc_id").alias("rep"), F.first("lanes").alias("lanes"), F.first("bins").alias("bins"))
    classes = cut(classes, "classes")
    # from here on rows need only the document that stands for their class: signatures and sets lie in the classes
    members = found.select("doc_id", "n", "set_id").join(classes.select("n", "set_id", "rep"), ["n", "set_id"], "left").select("doc_id", "n", "rep")
    members = cut(members, "members")
    free(spark, found)
    reps = classes.select(F.col("rep").alias("doc_id"), "n", "lanes", "bins", F.col("rep").alias("comp"))
    first = cut(candidates(reps.withColumn("bins", F.lit(None).cast("binary")), threshold, False, leaf), "pairs")
    ids = first.select(F.col("a").alias("doc_id")).unionByName(first.select("b").withColumnRenamed("b", "doc_id")).distinct()
    # one text for each id that has a candidate: its class's set is the same whatever row it comes from
    texts = cut(rows.join(ids, "doc_id").join(reps.select("doc_id"), "doc_id", "left_semi"), "texts")
    tried = cut(confirm(first, texts, k, threshold), "tried")
    links = tried.where("linked").groupBy("a", "b").agg(F.count("*"))

    def within(links: DataFrame) -> DataFrame:
        comps = components(links.select("a", "b")).withColumnRenamed("id", "doc_id")
        return reps.drop("comp").join(comps, "doc_id", "left").select("doc_id", "n", "lanes", "bins", F.coalesce("component", "doc_id").alias("comp"))

    moved = within(links).join(ids, "doc_id", "left_semi")
    second = candidates(moved, threshold, True, leaf).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    checked = cut(confirm(second, texts, k, threshold), "tried")
    more = checked.where("linked")
    free(spark, texts)
    moved = cut(within(links.select("a", "b").unionByName(more.select("a", "b"))), "moved")
    free(spark, classes)
    keys = cut(keyed(moved), "keys")
    regions = cut(dense_regions(keys, leaf), "regions")
    if regions.head(1):
        third = dense_candidates(moved, keys, regions, threshold, block)
        for old in (tried, checked):
            third = third.join(old.select("a", "b"), ["a", "b"], "left_anti")
        third = cut(third, "pairs")
        free(spark, moved, keys)
        ids = third.select(F.col("a").alias("doc_id")).unionByName(third.select("b").withColumnRenamed("b", "doc_id")).distinct()
        texts = rows.join(ids, "doc_id").join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
        more = more.unionByName(cut(confirm(third, texts, k, threshold).where("linked"), "more"))
    same = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.select("a", "b").unionByName(more.select("a", "b")).unionByName(same))
    out = members.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
