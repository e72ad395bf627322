"""The template rule against a plain search over all alignments, the filter, and odd tables."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import bloom, decontaminate
from tallyspark.llm.textkit import mix
from corpus_fixtures import texts  # noqa: F401


def _forms(text):
    """Folded words and, for each form, (word or placeholder, is slot)."""
    found = list(re.finditer(r"(?:[A-Za-z0-9]|(?<=[0-9])[.,](?=[0-9]))+", text or ""))
    words = [m.group() for m in found]
    folded = [w.lower() for w in words]
    number = [not re.search("[a-z]", w) or w in decontaminate.NUMBER_WORDS for w in folded]
    unit = [i > 0 and number[i - 1] and folded[i] in decontaminate.UNITS for i in range(len(words))]
    opens = [i == 0 or bool(re.search(r"[.!?:;\n|]", text[found[i - 1].end() : m.start()])) for i, m in enumerate(found)]
    capital = [bool(re.match("[A-Z].*[a-z]", w)) and not number[i] and not unit[i] for i, w in enumerate(words)]
    forms = []
    for name in ([c and not o for c, o in zip(capital, opens)], [c and f not in decontaminate.OPENERS for c, f in zip(capital, folded)]):
        forms.append([("#" if n else "%" if u else "@" if m else f, n or u or m) for f, n, u, m in zip(folded, number, unit, name)])
    return folded, [*forms, [(f, False) for f in folded]]


def _found(text, item, window, evidence, passage):
    """None if the item is not found, else whether it is exact."""
    doc, doc_forms = _forms(text)
    words, forms = _forms(item)
    size = min(window, len(words))
    if not words:
        return None
    if size < passage:
        return True if doc == words else None
    verdicts = []
    for shift in range(-len(words), len(doc)):
        hits = {}
        for at in range(max(0, -shift), len(words) - size + 1):
            if at + shift + size > len(doc):
                break
            for f in range(3):
                ours, theirs = forms[f][at : at + size], doc_forms[f][at + shift : at + shift + size]
                if [t for t, _ in ours] == [t for t, _ in theirs] and 2 * sum(s for _, s in ours) <= size:
                    pairs = {(words[at + k], doc[at + shift + k]) for k in range(size) if ours[k][1]}
                    for kind in {False, f == 2}:
                        hits.setdefault(kind, {}).setdefault(at, set()).update(pairs)
        for starts in hits.values():
            longest = run = 0
            for at in sorted(starts):
                run = run + 1 if at - 1 in starts else 1
                longest = max(longest, run)
            pairs = set().union(*starts.values())
            consistent = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
            if longest + size - 1 >= min(evidence, len(words)) and consistent:
                verdicts.append(all(a == b for a, b in pairs))
    return any(verdicts) if verdicts else None


def test_template_rule_equals_a_plain_search(spark, texts):
    rng = random.Random(11)
    vocabulary = ["the", "red", "cat", "What", "is", "Tom", "Ann", "Rome", "3", "17", "2.5", "two", "km", "hours", "of", "box"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ".", ",", "?"]) for _ in range(n))

    items = [prose(n) for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 14, 18)] + [None, "", "?!"]
    values = [None, ""]
    for item in items:
        for _ in range(9):
            text = item or "?"
            for _ in range(rng.randrange(3)):
                a, b = rng.choice(vocabulary), rng.choice(vocabulary)
                text = re.sub(rf"\b{re.escape(a)}\b", b, text)
            values.append(rng.choice(["", prose(3) + rng.choice([" ", ". "])]) + text + rng.choice(["", " " + prose(2)]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for window, evidence, passage in ((4, 6, 3), (8, 13, 5)):
        want = {}
        for i, text in enumerate(values):
            verdicts = {k: _found(text, item, window, evidence, passage) for k, item in enumerate(items)}
            want[i] = ([k for k, v in verdicts.items() if v is not None], sum(v is True for v in verdicts.values()))
        rows = decontaminate.contamination(texts(values), benchmark, window, evidence, passage).collect()
        assert {r.doc_id: (r.item_ids, r.n_exact) for r in rows} == want
        assert sum(bool(ids) for ids, _ in want.values()) > 20


def test_repeated_rows_clashing_columns_and_a_very_long_text(spark, texts):
    item = "The river Danube flows past the old walls of Vienna and Budapest before it turns south"
    benchmark = spark.createDataFrame([(1, item, "x"), (1, item, "x")], "item_id long, text string, hits string")
    long = "filler words here " * 60_000 + item
    docs = texts([long, "clean", None]).withColumns({c: F.lit("z") for c in ("hash", "id", "hits", "width", "item", "n_tokens", "run")})
    rows = decontaminate.contamination(docs.union(docs), benchmark).collect()
    assert sorted((r.doc_id, r.contaminated, r.n_items) for r in rows) == [(0, True, 1)] * 2 + [(1, False, 0)] * 2 + [(2, False, 0)] * 2


def test_filter_holds_its_keys_and_few_others(spark):
    keys = mix(np.arange(5000, dtype=np.uint64))
    frame = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long")
    table = bloom.build(frame, bloom.words_for(5000))
    assert bloom.holds(table, keys).all()
    assert bloom.holds(table, mix(np.arange(10_000, 110_000, dtype=np.uint64))).mean() < 0.01
    empty = bloom.build(frame.limit(0), bloom.words_for(0))
    assert not bloom.holds(empty, keys).any() and not len(bloom.holds(empty, keys[:0]))
    assert bloom.words_for(10**12) == bloom.MOST_WORDS
