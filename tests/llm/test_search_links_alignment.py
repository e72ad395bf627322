"""Ranked lexical search, covering simhash and cross-tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from corpus_fixtures import texts  # noqa: F401
from tallyspark.llm import alignment, lexical, simhash
from tallyspark.llm.queries import tokenizer

WORDS = "alpha Beta gamma über 漢字 x1 42 the The of zeta eta théta iota".split()
ODD = [None, "", "   ", "...", "ÀÉ àé", "a" * 5000, "\x00a\x7fb", "A_b-c.d", "tab\tand\nnew\r\nline", "it's 3.14% <s> <|endoftext|> </s>", "▁ low line", "  lead and trail  ", "x  y   z", "漢字仮名" * 300, "é ​ z"]


def corpus(seed, n, vocabulary=WORDS, longest=60):
    rng = random.Random(seed)
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, longest))) for _ in range(n)]


# ---- lexical ----


def terms(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def ranked(docs, items, k=10):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    bags = [b for b in bags if b[2]]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, bag, size in bags:
            m = 100 - 75 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1):
            out.append((item, r, d, -s))
    return sorted(out, key=str)


def items_table(spark, values, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 1) for i, t in enumerate(values)], "item_id long, text string, terms string, df long")


def lexical_rows(docs, items, **options):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(docs, items, **options).collect()], key=str)


def test_lexical_against_brute_force(spark, texts):
    values = corpus(1, 300) + ODD + ["the " * 500]
    asked = corpus(2, 40, longest=12) + ODD + ["unseen words only", "the the The " * 40, " ".join(WORDS) * 3]
    want = ranked(list(enumerate(values)), list(enumerate(asked)))
    assert lexical_rows(texts(values), items_table(spark, asked)) == want
    # Several groups of items, and k beyond the documents.
    assert lexical_rows(texts(values), items_table(spark, asked), group_items=7, group_entries=20) == want
    few = values[:6]
    assert lexical_rows(texts(few), items_table(spark, asked), k=50) == ranked(list(enumerate(few)), list(enumerate(asked)), 50)


def test_lexical_ties_nulls_and_repeats(spark, texts):
    values = ["alpha beta"] * 30 + ["gamma", "alpha"]
    ids = [9, None, 9, 5, *range(100, 126), 1, None]
    asked = ["alpha", "alpha", "gamma beta", None]
    got = lexical_rows(texts(values, ids), items_table(spark, asked, [1, 1, None, 4]))
    assert got == ranked(list(zip(ids, values)), list(zip([1, 1, None, 4], asked)))


def test_lexical_empty_tables(spark, texts):
    none = texts([])
    assert lexical_rows(none, items_table(spark, ["alpha"])) == []
    assert lexical_rows(texts(["alpha"]), items_table(spark, [])) == []
    assert lexical_rows(texts([None, " "]), items_table(spark, ["alpha"])) == []


def test_lexical_tiles_split_heavy_weights_and_wide_vocabularies():
    rng = np.random.default_rng(3)
    item, term = np.divmod(rng.choice(1500 * 2000, 9000, replace=False), 2000)
    weight = rng.integers(1, 30000, 9000)
    weight[:50] = rng.integers(1, 2**40, 50)
    tiles = lexical.Tiles(item, term.astype(np.int64), weight)
    doc, held = np.divmod(rng.choice(20 * 2000, 6000, replace=False), 2000)
    impact = rng.integers(1, 10**6, 6000)
    got = tiles.scores(doc, held.astype(np.int64), impact, 20)
    facts = {(d, t): i for d, t, i in zip(doc.tolist(), held.tolist(), impact.tolist())}
    want = Counter()
    by_item = defaultdict(list)
    for i, t, w in zip(item.tolist(), term.tolist(), weight.tolist()):
        by_item[i].append((t, w))
    place = {int(x): n for n, x in enumerate(tiles.items)}
    for i, uses in by_item.items():
        for d in range(20):
            want[d, place[i]] = sum(w * facts.get((d, t), 0) for t, w in uses)
    assert all(int(got[d, i]) == v for (d, i), v in want.items())
    assert lexical.TILE_TERMS * lexical.MOST_WEIGHT * 10**6 < 2**53


def test_lexical_long_texts_in_pieces(spark, texts, monkeypatch):
    words = list(np.random.default_rng(5).choice(WORDS, 400_000))
    values = [" ".join(words) + " " + "q" * 9_000_000 + " alpha", "alpha beta"]
    asked = ["alpha über", "漢字 42"]
    assert lexical_rows(texts(values), items_table(spark, asked)) == ranked(list(enumerate(values)), list(enumerate(asked)))


def test_lexical_impacts_beyond_64_bits():
    n = np.array([3, 10**13])
    got = lexical.impacts(np.array([2, 5]), n, 10**7, 10**10)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * x * 10**7 // 10**10)) for t, x in ((2, 3), (5, 10**13))]


# ---- simhash ----


def print_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(prints, radius):
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def test_simhash_against_brute_force(texts):
    base = corpus(7, 60)
    values = base + base[:20] + [t + " extra" for t in base[:30]] + ODD + ["one", "one two", "ONE TWO", "One  two"]
    prints = [print_of(t) for t in values]
    rows = {r.doc_id: r for r in simhash.near_duplicates(texts(values)).collect()}
    assert [rows[i].fingerprint for i in range(len(values))] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in range(len(values))] == component_of(prints, 2)


def test_simhash_pieces_equal_the_whole(monkeypatch):
    text = " ".join(corpus(8, 40)) + "\t\n x  " + "w" * 300 + "\x1c\x85 y z"
    want = print_of(text)
    assert simhash.fingerprint(text.encode()) == want
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text.encode()) == want


def test_simhash_repeats_nulls_and_empty_tables(texts):
    values, ids = ["a b c d", "a b c d", None, "", "z z z"], [4, 4, None, 8, None]
    rows = simhash.near_duplicates(texts(values, ids)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == sorted([(4, 4), (4, 4), (None, 8), (8, 8), (None, None)], key=str)
    assert simhash.near_duplicates(texts([])).collect() == []


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    cover = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
    rng = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not m & flips for m in cover)
    if radius == 2:
        assert all(any(not m & (1 << a | 1 << b) for m in cover) for a in range(64) for b in range(64))


@pytest.mark.parametrize("radius,cell", [(2, 64), (2, 4), (2, 2), (1, 4), (3, 8)])
def test_links_of_dense_balls_give_the_same_components(spark, radius, cell):
    rng = random.Random(radius * 100 + cell)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, cell).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius for r in found)
    group = {v: v for v in signed}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for r in found:
        a, b = root(r.a), root(r.b)
        group[max(a, b)] = min(a, b)
    want = component_of(values, radius)
    got = [root(v) for v in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


# ---- alignment ----


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


def plain_alignment(values, both):
    a, b = both
    own = alignment.Aligner(tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    found = []
    for text in values:
        whole = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        if b"".join(own.bytes_a[i] for i in ids_a) != whole or b"".join(own.bytes_b[i] for i in ids_b) != whole:
            ids_a, ids_b = [], []
        spans = []
        for ids, table in ((ids_a, own.bytes_a), (ids_b, own.bytes_b)):
            ends = np.cumsum([len(table[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids)))
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [",".join(str(x) for s, e, x in spans[0] if s >= low and e <= high) + "|" + ",".join(str(y) for s, e, y in spans[1] if s >= low and e <= high) for low, high in zip([0, *cuts], cuts)]
        found.append((ids_a, ids_b, groups, links))
    count = Counter(p for *_, links in found for p in set(links))
    high = defaultdict(int)
    for (x, _), n in count.items():
        high[x] = max(high[x], n)
    return [
        (len(x), len(y), len(g), len(links), sum(count[p] == high[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
        for x, y, g, links in found
    ]


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(docs, **options):
    rows = alignment.align(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), **options).collect()
    return sorted([(r.doc_id, *[r[f] for f in FIELDS]) for r in rows], key=str)


def test_alignment_against_brute_force(texts, both):
    more = ["Unbelievable internationalisation, naïve façade!", "def f(x):\n    return x  # done\n", "a b c", "1234567 89.10", "word " * 200 + "end", "😀 smile 👩‍👩‍👧 family", "x\x1cy z", "don't we'll I've"]
    values = corpus(11, 60) + ODD + more
    want = plain_alignment(values, both)
    assert aligned(texts(values)) == sorted([(i, *w) for i, w in enumerate(want)], key=str)
    # Many runs, merged over several levels, give the same.
    assert aligned(texts(values).repartition(7), run_bytes=200, fan=3) == sorted([(i, *w) for i, w in enumerate(want)], key=str)


def test_alignment_repeats_nulls_and_empty_tables(texts, both):
    values, ids = ["same words here"] * 3 + [None, "other words"], [4, 4, None, 7, None]
    want = plain_alignment(values, both)
    assert aligned(texts(values, ids)) == sorted([(i, *w) for i, w in zip(ids, want)], key=str)
    assert aligned(texts([])) == []
    assert aligned(texts([None, ""])) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_words_of_a_text_encode_as_the_whole(both, monkeypatch):
    own = alignment.Aligner(tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    assert own.cuts
    monkeypatch.setattr(alignment, "PIECE_CHARS", 40)
    for text in [t for t in corpus(12, 20) + ODD if t]:
        words = [w for some in own.words(text) for w in some]
        assert " ".join(words) == text
        assert [i for w in words for i in both[0].encode(" " + w, add_special_tokens=False).ids] == both[0].encode(" " + text, add_special_tokens=False).ids
        assert [i for w in words for i in both[1].encode(w)] == both[1].encode(text)


def test_merge_counts_in_order_and_marks_maxima():
    rng = random.Random(4)
    runs = [sorted({rng.randint(0, 6) << 32 | rng.randint(0, 30) for _ in range(80)}) for _ in range(9)]
    frames = [alignment._frames(((p, rng.randint(1, 5)) for p in r), 2) for r in runs]
    want = Counter()
    for f in frames:
        for p, c in alignment._entries(f):
            want[p] += c
    got = list(alignment.with_maxima(alignment.merged(frames)))
    assert [(p, c) for p, c, _ in got] == sorted(want.items())
    high = {a: max(c for p, c in want.items() if p >> 32 == a) for a in {p >> 32 for p in want}}
    assert all(b == (c == high[p >> 32]) for p, c, b in got)
    assert list(alignment.merged([])) == [] and list(alignment.with_maxima(iter([]))) == []


# ---- scores from counts ----


def backoff_scores(values, order, factor=0.4):
    words = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in values]
    held = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    every, total = sum(held, Counter()), sum(map(len, words))
    out = []
    for w, own in zip(words, held):
        logs, cuts = [], 0
        for i in range(len(w)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                seen = every[gram] - own[gram]
                if seen:
                    below = every[gram[:-1]] - own[gram[:-1]] if n > 1 else total - len(w)
                    logs.append(math.log(seen / below * factor ** (longest - n)))
                    break
            else:
                logs.append(math.log(factor ** (longest - 1) / (total - len(w) + 1)))
                n = 0
            cuts += longest > 1 and n < longest
        out.append((len(w), cuts, sum(logs) / len(logs) if logs else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_with_repeated_rows_and_long_texts(texts, order):
    from tallyspark.llm import lm_score

    long = " ".join(np.random.default_rng(1).choice(WORDS, 300_000))
    values = corpus(21, 40) + ODD + ["the same row again and again"] * 50 + [long, "one", "one one", "solo"]
    rows = {r.doc_id: r for r in lm_score.scores(texts(values), order=order).collect()}
    for i, (n, cuts, score) in enumerate(backoff_scores(values, order)):
        assert (rows[i].n_words, rows[i].n_backoff) == (n, cuts)
        assert rows[i].lm_score is None if score is None else abs(rows[i].lm_score - score) < 1e-9
