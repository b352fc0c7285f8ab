"""Spelling variants, lexical search and phrase fingerprints against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mergetide.llm import lexical
from mergetide.llm.lexical import Treap, ranked_search, tree_of
from mergetide.llm.phrases import Document, fingerprint, likeness, likeness_of, phrase_fingerprints
from mergetide.llm.spelling import spelling_variants, word_counts

SCHEMA = "doc_id long, text string, word string, n long, item string, term string, part int, place int, ids string"


def table(spark, rows):
    """Documents with columns whose names clash with those used inside the operators."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2, 3, "k") for i, t in rows], SCHEMA)


# spelling variants


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def test_spelling_variants(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 11))) for _ in range(12)] + ["l" * 9, "l" * 10, "a" * 47, "a" * 48, "a" * 49, "a" * 50, "ab" * 40, "ab" * 39 + "b", "x" + "ab" * 40, "×÷" * 4]
    rows = [(None, "Fooooooo fooooooo fooooooo"), (1, None), (2, ""), (3, " ,. "), (4, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 2999 + " " + "z" * 2999)]
    for i in range(5, 90):
        words = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.3)), len(stems) - 1)]
            k = rng.randrange(len(w))
            words.append(rng.choice([w, w, w, w.upper() if w.isascii() else w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]]))
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    rows += rows[5:9]
    want = variants(counted(rows))
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants(word_counts(table(spark, rows))).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == want and any(f for f, *_ in want.values()) and "z" * 3000 in want and want["z" * 3000][3] == 1


def test_no_words(spark):
    assert spelling_variants(word_counts(table(spark, []))).count() == 0
    assert spelling_variants(word_counts(table(spark, [(1, "short words only")]))).count() == 0


# lexical search


def best(rows, items, k):
    terms = lambda t: re.findall(lexical.TERM, "".join(c.lower() if c.isascii() else c for c in t or ""))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in docs:
            if c:
                m = 50 + 50 * sum(c.values()) * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
                scores += [(-s, doc_id is None, doc_id)] if s > 0 else []
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_ranked_search(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "x1"]
    text = lambda n: rng.choice([" ", "-", ".\n"]).join(rng.choice([w, w.upper()]) for w in (vocabulary[min(int(rng.expovariate(0.08)), 62)] for _ in range(n)))
    rows = [(i, text(rng.randrange(1, 60))) for i in range(150)] + [(200, None), (201, ""), (202, "...!"), (203, "w1 " * 5000), (None, "w1 w2 w3"), (204, "w1 w2 w3")]
    rows += [(i, "w5 w6 w7 w8") for i in range(300, 340)] + rows[:3]
    items = [(i, text(rng.randrange(1, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "unknown-term"), (53, "w5 w6"), (54, "w1"), (54, "w2 w2"), (55, " ".join(vocabulary))]
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, item int")
    for docs, width in ((4096, 256), (7, 2)):  # one block a task, or many small ones and few ranges at once
        monkeypatch.setattr(lexical, "BLOCK_DOCS", docs)
        monkeypatch.setattr(lexical, "WIDTH", width)
        got = ranked_search(table(spark, rows).repartition(3), asked, k=20).select("item_id", "rank", "doc_id", "score")
        assert sorted((tuple(r) for r in got.collect()), key=str) == best(rows, items, 20)
    monkeypatch.setattr(lexical, "BATCH_BYTES", 200)  # several batches of items
    got = ranked_search(table(spark, rows), asked, k=5).select("item_id", "rank", "doc_id", "score")
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(rows, items, 5)
    assert ranked_search(table(spark, []), asked).count() == 0 and ranked_search(table(spark, rows), asked.limit(0)).count() == 0


def test_treap_against_the_grid():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n_rows, n_cols = rng.integers(1, 40, 2)
        grid = np.where(rng.random((n_rows, n_cols)) < 0.3, rng.integers(1, 9, (n_rows, n_cols)), 0)
        rows, cols = np.nonzero(grid)
        if not len(rows):
            continue
        depth = max(1, int(max(n_rows, n_cols) - 1).bit_length())
        treap = Treap(depth, *tree_of(rows, cols, grid[rows, cols], depth))
        asked = np.unique(rng.choice(rows, 5))
        weights = rng.integers(1, 4, len(asked))
        scores = weights @ grid[asked]
        want = sorted(((int(s), c) for c, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))[:4]
        assert treap.top(asked, weights, 4, 1) == want


# phrase fingerprints


def phrases(data):
    known, piece = set(), b""
    for i in range(len(data)):
        piece += data[i : i + 1]
        if piece not in known:
            known.add(piece)
            piece = b""
    return known


def test_parse_and_likeness():
    rng = random.Random(1)
    text = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    for n in (0, 1, 5, 300, 4000):
        doc = Document(1, t := text(n, "aé b"))
        kept = phrases(t[: n - n // 4].encode())
        assert len(doc.phrases) == len(kept)
        assert doc.fingerprint == fingerprint(t) and doc.with_end("xyz") == fingerprint(t[: n - n // 4] + "xyz") and doc.with_end(t[n - n // 4 :]) == fingerprint(t)
    errors = []
    for _ in range(30):
        a = text(3000)
        b = a[: (k := rng.randrange(3000))] + text(3000 - k)
        one, two = phrases(a.encode()), phrases(b.encode())
        errors.append(likeness(fingerprint(a), fingerprint(b)) - len(one & two) / len(one | two))
    assert abs(sum(errors) / 30) < 0.03 and max(map(abs, errors)) < 0.16
    assert (likeness("", ""), likeness("", fingerprint("a")), likeness(fingerprint("ab"), fingerprint("ab"))) == (1.0, 0.0, 1.0)


def test_phrase_fingerprints(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcé \U0001f600") for _ in range(rng.randrange(400)))) for i in rng.sample(range(1000), 60)] + [(2000, None), (2001, ""), (2002, "abc"), (2003, "x" * 50_000), (-5, "first"), (None, "nothing")]
    for docs in (rows, rows[:1], rows[:2]):
        order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
        got = {r["doc_id"]: r.asDict() for r in phrase_fingerprints(table(spark, docs).repartition(5)).collect()}
        assert len(got) == len(docs)
        for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
            t, u, r = t or "", u or "", got[i]
            edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint(t), fingerprint(edited))
            assert (r["near_edited"], r["near_next"]) == (likeness(fingerprint(t), fingerprint(edited)), likeness(fingerprint(t), fingerprint(u)))
    found = phrase_fingerprints(table(spark, rows)).select("near_edited", likeness_of("fingerprint", "edited_fingerprint").alias("again")).collect()
    assert all(r["near_edited"] == pytest.approx(r["again"]) for r in found)
    assert phrase_fingerprints(table(spark, [])).count() == 0
    twice = phrase_fingerprints(table(spark, [(1, "b"), (1, "a"), (1, "b")])).collect()
    assert sorted(r["n_chars"] for r in twice) == [1, 1, 1] and len({r["fingerprint"] for r in twice}) == 2
