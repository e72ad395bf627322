"""Top-k, near duplicates, repeated substrings and components against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from corpus_fixtures import texts  # noqa: F401
from tallyspark.llm import near_dedup, runindex, substrings, topk
from tallyspark.llm.components import components


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def bag(text, n=5):
    w = words(text)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def classes(values, similarity=0.8):
    bags = [bag(t) for t in values]
    group = list(range(len(values)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a & bags[j]).values())
            if both and both / (sum(a.values()) + sum(bags[j].values()) - both) >= similarity:
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(values))]


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=rng.integers(5, 9)).tolist(), 1) for i in range(-20, 300)]
    rows += [(500, rows[3][1], 1), (501, rows[3][1], 1), (501, rows[3][1], 1), (600, None, 1), (None, [1.0], 1), (650, [float("nan"), 1.0], 1), (700, [float("inf")], 1), (750, [None, 1.0], 1), (800, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, shard=64, block=3).collect()}
    held = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in held:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(held[q], v, strict=False)), i) for i, v in held.items() if i != q)[:5]
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id in (50, 51)")).count() == 1
    big = spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, 1e6 + 1]), (2, [1e6 + 1, 1e6 + 1])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.top_k(big).orderBy("rank").collect()] == [256 * 256 * (2 * 10**12 + 2 * 10**6), 256 * 256 * (2 * 10**12 + 10**6)]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 2**63, 60, dtype=np.uint64)
    a = Counter({int(k): int(rng.integers(1, 40)) for k in keys[:45]})
    b = Counter({int(k): a[int(k)] + int(rng.integers(0, 3)) for k in keys[10:]})

    def sign(c):
        hashes = np.sort(np.array(list(c.elements()), np.uint64))
        return near_dedup.signatures(hashes, np.zeros(len(hashes), np.int64), 1, 4096)[0]

    want = sum((a & b).values()) / sum((a | b).values())
    assert abs((sign(a) == sign(b)).mean() - want) < 0.03


def test_near_duplicate_classes(texts):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(500)]
    base = rng.choice(vocabulary, 100).tolist()
    values = [None, "", "?!", "one two", "One, two!", "two one"]
    for edits in rng.integers(0, 6, 90):  # a group of near copies that differ from each other
        copy = list(base)
        for at in rng.integers(0, 100, edits):
            copy[at] = str(rng.choice(vocabulary))
        values.append(" ".join(copy))
    values += [" ".join(rng.choice(vocabulary, rng.integers(1, 60))) for _ in range(60)] + ["la " * 3000, "la " * 2900, "la " * 1000] + values[10:14]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(texts(values), bands=40, cell=16).collect()}
    assert got == dict(enumerate(classes(values)))
    assert near_dedup.near_duplicates(texts(values).limit(0)).count() == 0


def test_near_duplicates_of_repeated_rows_and_null_ids(texts):
    rows = near_dedup.near_duplicates(texts(["a b c d e f"] * 3 + ["x y z", None], ids=[7, 7, 4, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in rows) == [("4", "4", 3), ("7", "4", 3), ("7", "4", 3), ("None", "None", 1), ("None", "None", 1)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)] + [(300, 301 + i) for i in range(50)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {i: 300 for i in range(300, 351)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(3)
    for trial in range(40):
        values = [bytes(rng.integers(97, 98 + trial % 4, rng.integers(0, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        for a, (text, told) in enumerate(zip(values, runindex.matching_statistics(values), strict=True)):
            for i in range(len(text)):
                others = [(u, j) for b, u in enumerate(values) for j in range(len(u)) if (a, i) != (b, j)]
                assert told[i] == max((next((n for n in range(60) if text[i + n : i + n + 1] != u[j + n : j + n + 1] or i + n >= len(text)), 60) for u, j in others), default=0)


def removed(values, length):
    raw = [(t or "").encode() for t in values]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        keep = np.ones(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                keep[i : i + length] = False
        kept = np.frombuffer(t, np.uint8)[keep].tobytes()
        runs = int((np.diff(np.concatenate([[0], ~keep, [0]]).astype(int)) == 1).sum())
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "crowd"), [(40, 8, 512), (100, 32, 512), (40, 8, 3)])
def test_repeated_substrings(texts, length, gram, crowd):
    rng = np.random.default_rng(4)
    pool = ["".join(rng.choice(list("abcdé"), 200)) for _ in range(12)]
    values = [None, "", "a" * 700, "é" * 500, "ab" * 300 + "c", "x\x00y" * 90]
    for _ in range(50):
        values.append("".join(pool[rng.integers(12)][rng.integers(0, 80) :] if rng.random() < 0.6 else "".join(rng.choice(list("xyzw "), 150)) for _ in range(rng.integers(0, 6))))
    values += values[10:13]
    rows = substrings.remove_repeats(texts(values), length, gram, crowd).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == removed(values, length)


def test_repeated_substrings_of_repeated_rows(texts):
    rows = substrings.remove_repeats(texts(["p" * 30 + "q" * 30, "p" * 30 + "q" * 30, "z"], ids=[1, 1, None]), 40, 8).collect()
    assert sorted((r.n_removed, r.kept.decode()) for r in rows) == [(0, "z"), (60, ""), (60, "")]
    assert substrings.remove_repeats(texts([]), 40, 8).count() == 0
