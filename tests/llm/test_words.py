"""Operators that read words, against plain Python on small texts."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mergetide.llm.components import components
from mergetide.llm.lsh_forest import near_duplicates
from mergetide.llm.mixing import mix_sources
from mergetide.llm.quality import quality_rules
from mergetide.llm.recompress import dedup_substrings
from mergetide.llm.suffixes import repeated_passages
from mergetide.llm.tokens import words_of

SCHEMA = "doc_id long, text string, n long, start int, size string, source string, spans string, tag string, key string"


def table(spark, texts, ids=None, sources=None):
    """Documents with columns whose names clash with those used inside the operators."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, 1, 2, "x", sources[k] if sources else "s", "y", "z", "k") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_texts(seed=1, n=40):
    """Few words, so that windows, runs and periods repeat; null, empty, blank and very long texts among them."""
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a", "Ünï code wörds " * 30, "x " * 400, "one two three " * 60, " ".join(f"w{i}" for i in range(9000))]
    for _ in range(n):
        parts = [" ".join(rng.choice(["a", "b", "cc"]) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))]
        out.append(rng.choice([" ", "\n", "\t "]).join(parts))
    out += [out[-1], out[-2], "x " * 390 + "y"]
    base = [f"u{i}" for i in range(120)]
    out += [" ".join(base), " ".join(["q"] * 3 + base[10:80] + ["r"]), " ".join(base[30:95])]
    return out


def test_words():
    texts = ["a  bb\x0bc", None, "", "é x y", " z"]
    w = words_of(pa.array(texts))
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.row[:-1], w.row[1:], strict=True)]
    assert got == [words(t) for t in texts]
    assert words_of(pa.array(["ab"])).hashes[0] == words_of(pa.array(["x", "y ab z"]).slice(1)).hashes[1]


def test_quality(spark):
    texts = [*odd_texts(), "the cat and the dog of it " * 20 + "#% <a>", "l one\nl one\n\n\nl two"]
    got = {r["doc_id"]: r for r in quality_rules(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ws = words(t)
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        inside = {j + k for j in range(len(ws) - 2) for k in range(3) if grams[tuple(ws[j : j + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(inside) > 50 * len(ws))
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules(table(spark, [])).count() == 0


def covered(texts, width):
    """Per text: words in windows that occur anywhere else, and in those that occur earlier."""
    places = defaultdict(list)
    for i, t in enumerate(texts):
        ws = words(t)
        for j in range(len(ws) - width + 1):
            places[tuple(ws[j : j + width])].append((i, j))
    every, late = defaultdict(set), defaultdict(set)
    for where in places.values():
        for n, (i, j) in enumerate(where):
            if len(where) > 1:
                every[i].update(range(j, j + width))
            if n:
                late[i].update(range(j, j + width))
    return every, late


@pytest.mark.parametrize("width", [5, 20])
def test_recompression(spark, width):
    texts = odd_texts(2)
    _, late = covered(texts, width)
    got = {r["doc_id"]: r for r in dedup_substrings(table(spark, texts), width).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws = words(t)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(ws), len(late[i]))
        assert got[i]["kept"] == " ".join(w for j, w in enumerate(ws) if j not in late[i])
    assert dedup_substrings(table(spark, []), width).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = table(spark, [text, text, text], ids=[4, 4, None])
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in dedup_substrings(rows, 20).collect()) == [(0, 0), (4, 30), (4, 30)]


def test_suffix_arrays(spark):
    texts = odd_texts(3)
    every, late = covered(texts, 50)
    got = {r["doc_id"]: r for r in repeated_passages(table(spark, texts), 50).collect()}
    assert set(got) == {i for i in every if every[i]}
    for i, r in got.items():
        assert {j for s in r["spans"] for j in range(s["start"], s["stop"])} == every[i]
        assert {j for s in r["removable"] for j in range(s["start"], s["stop"])} == late[i]
        assert (r["n_repeated"], r["n_removable"]) == (len(every[i]), len(late[i]))
    assert repeated_passages(table(spark, []), 50).count() == 0


def hot_texts(width):
    """A passage shorter than the window in all documents with other words around it, a longer one, and copies."""
    short, long = ([f"{c}{i}" for i in range(n)] for c, n in (("p", width * 4 // 5), ("q", width + 5)))
    texts = [" ".join([*(f"a{i}x{j}" for j in range(60)), *short, *(f"b{i}x{j}" for j in range(60)), *(long if i % 2 else [])]) for i in range(100)]
    return texts + texts[:10] + [None, "", texts[3] + " x"]


def test_hot_keys_are_split(spark):
    texts = hot_texts(20)
    _, late = covered(texts, 20)
    for hot in (1, 100):
        got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in dedup_substrings(table(spark, texts), 20, hot=hot).collect()}
        assert got == {i: (len(late[i]), " ".join(w for j, w in enumerate(words(t)) if j not in late[i])) for i, t in enumerate(texts)}


def test_hot_suffixes(spark):
    texts = hot_texts(50)
    every, late = covered(texts, 50)
    got = {r["doc_id"]: (r["n_repeated"], r["n_removable"]) for r in repeated_passages(table(spark, texts), 50).collect()}
    assert got == {i: (len(every[i]), len(late[i])) for i in every if every[i]}


def test_suffixes_are_sparse(spark):
    """Far fewer suffixes than windows are retained, and only the ends of passages are extended."""
    from mergetide.llm import suffixes
    from mergetide.llm.windows import identified

    rng = random.Random(12)
    base = [f"t{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [" ".join(base), " ".join([*(f"y{i}" for i in range(300)), *base[500:1500], *(f"z{i}" for i in range(300))])]
    rows = suffixes.retained_suffixes(identified(table(spark, texts), "doc_id", "text"), 50, 16)
    n_windows = sum(len(words(t)) - 49 for t in texts)
    assert rows.count() < n_windows / 14
    grams, starts = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64), np.arange(4)
    assert suffixes.minimisers(grams, starts, 4).tolist() == [1, 4, 4, 4] and suffixes.minimisers(grams, np.arange(5), 3).tolist() == [1, 1, 4, 4, 4]


def links_of(texts, k, threshold=80):
    sets = []
    for t in texts:
        ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set())
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(seed):
    rng = random.Random(seed)
    texts = odd_texts(seed, 25)
    for _ in range(25):
        base = [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    texts = near_copies(k)
    sizes, tops = links_of(texts, k)
    got = {r["doc_id"]: r for r in near_duplicates(table(spark, texts), k).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == tops
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert len(set(tops)) < len(texts) - 20


def test_large_regions_are_cut_and_read_in_blocks(spark):
    from mergetide.llm import lsh_forest

    assert list(lsh_forest.leaves(np.sort(np.array([1 << 40] * 5 + [2 << 40] * 5 + [3 << 40] * 2)), 0, 12, 8)) != [(0, 12)]
    base = [f"t{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "z", *base[i + 1 :]]) for i in range(120)]
    got = near_duplicates(table(spark, texts), 4, leaf=8).collect()
    assert {r["component_id"] for r in got} == {0}


def test_partners_in_far_blocks(spark):
    """A family under the threshold that agrees on most lanes, and pairs over it whose ids lie many blocks apart."""
    base = [f"t{i}" for i in range(1000)]
    texts = []
    for i in range(90):
        at = 100 + 9 * i
        texts.append(" ".join([*base[:at], f"own{i}", *base[at + 1 :]]))
    texts += [f"more {t}" for t in texts[:45]]
    _, tops = links_of(texts, 4, 99)
    assert tops == [*range(90), *range(45)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, texts), 4, 99, leaf=4, block=16).collect()}
    assert [got[i] for i in range(len(texts))] == tops


def test_signatures_go_when_they_are_read(spark, monkeypatch):
    """Signatures lie once in the shared folder after the classes are made, and not at all when the third round is confirmed."""
    from mergetide.llm import lsh_forest
    from mergetide.sources import shared

    base = [f"t{i}" for i in range(1000)]
    texts = [" ".join([*base[: 100 + 9 * i], f"own{i}", *base[101 + 9 * i :]]) for i in range(40)]
    texts += [f"more {t}" for t in texts[:20]] + texts[:5]
    folder = shared.shared_dir(spark).removeprefix("file:")
    old, there = set(os.listdir(folder)), {}

    def cut(df, name="cut"):
        out = shared.cut(df, name)
        there[name] = {f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - old}
        return out

    monkeypatch.setattr(lsh_forest, "cut", cut)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, texts), 4, 99, leaf=4, block=16).collect()}
    assert [got[i] for i in range(len(texts))] == links_of(texts, 4, 99)[1]
    assert "signatures" not in there["texts"] and "classes" in there["texts"]
    assert "moved" in there["inside"] and not {"signatures", "classes"} & there["inside"]
    assert not {"signatures", "classes", "moved", "keys"} & there["more"]


def test_near_duplicates_without_ids_or_rows(spark):
    text = "a b c d e f g"
    got = near_duplicates(table(spark, [text, text, text], ids=[None, 7, 7]), 4).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (7, 7, True), (7, 7, True)]
    assert near_duplicates(table(spark, []), 4).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(10, 40)] + [(5, 3), (3, 3), (50, 51), (51, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(11, 41)}, 5: 3, 51: 50}


def fill(sizes, weights, total):
    """Water filling by rounds: shares by weight, the excess over the caps shared again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        give = {s: left * weights[s] / w for s in open_}
        left = 0.0
        for s, x in give.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(4)
    names = ["b", "a", None, "é", "B", "empty"]
    share = [500, 60, 60, 200, 150, 3]
    sources = [s for s, n in zip(names, share, strict=True) for _ in range(n)]
    texts = [None if s == "empty" else " ".join(["w"] * rng.randrange(60)) for s in sources]
    docs = table(spark, texts, sources=sources)
    got = mix_sources(docs).collect()
    assert len(got) == len(texts)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(docs.repartition(7)).collect()))
    sizes = {s: sum(len(words(t)) for t, x in zip(texts, sources, strict=True) if x == s) for s in names}
    order = sorted((s for s in names if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        s = sources[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (len(words(texts[r["doc_id"]])), sizes[s])
        assert abs(r["target"] - want[s]) < 1e-6 and r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in names)
    assert mix_sources(table(spark, [])).count() == 0


def test_mixing_plans_its_small_tables_once(spark):
    docs = table(spark, ["w " * (i + 1) for i in range(20)], sources=[str(i % 2) for i in range(20)])
    assert mix_sources(docs)._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1  # of the documents at the edge


def test_mixing_weighs_sizes(spark):
    """One source that is left at 1.2 copies: longer documents are drawn more often, and so are those of equal or null ids."""
    rng = random.Random(5)
    texts = [" ".join(["w"] * n) + f" {i}" for i, n in enumerate(rng.choices([10, 50, 200], [4, 4, 1], k=3000))]
    ids = [None if i % 3 == 0 else i % 5 for i in range(3000)]
    docs = table(spark, texts, ids=ids, sources=["s"] * 3000)
    got = mix_sources(docs, share=1.2).collect()
    total = sum(len(words(t)) for t in texts)
    assert len(got) == 3000 and abs(sum(r["taken"] for r in got) - 1.2 * total) <= 201
    copies = {n: np.mean([r["taken"] / r["size"] for r in got if r["size"] == n + 1]) for n in (10, 50, 200)}
    assert copies[10] + 0.2 < copies[50] < copies[200] - 0.2 and all(r["taken"] <= 2 * r["size"] for r in got)
    null = np.mean([r["taken"] / r["size"] for r in got if r["doc_id"] is None])
    assert abs(null - np.mean([r["taken"] / r["size"] for r in got])) < 0.1


def test_kept_text_hash(spark):
    """What op7 returns of the kept text."""
    from pyspark.sql import functions as F

    r = dedup_substrings(table(spark, ["a  b\nc"]), 20).select(F.sha2(F.col("kept").cast("binary"), 256).alias("h")).first()
    assert r["h"] == hashlib.sha256(b"a b c").hexdigest()
