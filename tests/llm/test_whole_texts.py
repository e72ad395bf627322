"""Texts that a shorter way would count, label, redact or match only in part."""

import textwrap

import numpy as np
from pyspark.sql import functions as F

from corpus_fixtures import texts  # noqa: F401
from tallyspark.llm import bloom, decontaminate, language, licences, private_data, token_counts
from tallyspark.llm.queries import tokenizer


def test_token_counts_with_spaces_at_the_start_alone(texts):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    values = ["Title words here " + "é" * 12000, "a bc " + "QUJDRA==" * 3000, " x y " + "漢字仮名" * 2500 + " end of it", "one two " + "é" * 70 + " z " + "é" * 90]
    want = [len(whole.encode(t)) for t in values]
    for chunk, overlap in ((8192, 256), (64, 2), (40, 39)):
        rows = token_counts.token_counts(texts(values), path, chunk=chunk, overlap=overlap).orderBy("doc_id").collect()
        assert [r.n_tokens for r in rows] == want


def test_licences_in_wrapped_and_commented_texts(texts):
    s = licences.SENTENCES
    mit = f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{s['mit-grant']}:\n\n{s['mit-notice']}.\n\n{s['mit-warranty'].upper()}. IN NO EVENT SHALL THE AUTHORS BE LIABLE."
    bsd = f"Copyright 2020 A. Person. All rights reserved.\n\n{s['bsd-grant']}:\n\n1. {s['bsd-source']}.\n\n2. {s['bsd-binary']}.\n\n3. {s['bsd-names']}."
    apache = f"{s['apache-header']};\n{s['apache-comply']}.\n{s['apache-copy']}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{s['apache-basis']}.\n{s['apache-see']}."
    gpl3 = f"{s['gpl3-free']}.\n\n{s['gpl-hope']}; {s['gpl-implied']}.  {s['gpl-details']}."
    gpl2 = f"{s['gpl2-free']}.\n\n{s['gpl-hope']}; {s['gpl-implied']}.  {s['gpl-details']}."
    forms = [mit, bsd, apache, f"{s['isc-grant']}.", gpl3, gpl2]
    want = ["MIT", "BSD-3-Clause,proprietary", "Apache-2.0", "ISC", "GPL-3.0-or-later", "GPL-2.0-or-later"]

    def wrap(text, width, prefix, end):
        lines = [x for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""])]
        return "int a;" + end + end.join(f"{prefix}{x}".rstrip() for x in lines) + end + "int b;"

    # Text begins the file or follows a blank line, as in real headers.
    values = [wrap("\n" + t + "\n", w, p, e) for t in forms for w, p, e in ((72, "", "\n"), (76, "# ", "\n"), (70, " * ", "\r\n"), (60, "// ", "\n"), (50, "; ", "\r"), (66, "dnl ", "\n"), (200, "-- ", "\n"))]
    # A line before without a blank line; bullets without blank lines; a header's longer form on two lines; a mark on its own line.
    values += [f"Copyright A\n{textwrap.fill(mit[50:], 70)}", "\n".join(textwrap.fill(x, 75, initial_indent="  * ", subsequent_indent="    ") for x in (s["bsd-source"] + ".", s["bsd-binary"] + "."))]
    values += ["Licensed under the Apache License,\nVersion 2.0\n(the \"License\")", "# all rights\n# reserved", "x\n# SPDX-License-Identifier: MIT\n# y", "Released under the MIT License and\nothers", "漢" * 50000 + "licence" + "。" * 50000]
    rows = {r.doc_id: r for r in licences.scan(texts(values)).collect()}
    per = len(values[: -7]) // len(forms)
    for i, w in enumerate(want):
        assert [rows[i * per + k].licences for k in range(per)] == [w] * per
    n = per * len(forms)
    assert rows[n + 1].sentence_ids == "bsd-source,bsd-binary"
    assert [rows[n + k].sentence_ids for k in range(2, 7)] == ["apache-header", "reserved", "spdx-mit", "", ""]


def test_contamination_whatever_stands_before(spark, texts):
    items = [
        "What is the capital of France", "Tom has 3 apples. Tom gives 2 apples to Ann. How many apples are left for Tom",
        "The river Danube flows past the old walls of Vienna and Budapest before it turns south near Belgrade and ends in a delta",
        "Compute 12 + 45 * 3 - 7 / 2", "on 3 May 1912, 4 June 1913, 5 July 1914 and 6 August 1915 they met 12 times",
    ]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    values = [
        "he asked What is the capital of France, and left", "Mia has 7 apples. Mia gives 4 apples to Bob. How many apples are left for Mia",
        "so: " + items[2].replace("past the ", "past the\n").replace("and Budapest", "and\nBudapest").replace("near ", "near\n"), "please Compute 12 + 45 * 3 - 7 / 2 now", "I say " + items[4],
        "Mia has 7 apples. Mia gives 4 apples to Bob. How many apples are left for Zoe", "he asked what is the price of bread", "please Compute 12 + 45 * 3 - 7 / 3 now",
        # Verbatim, then a second, inconsistent part on the same alignment.
        items[2][: items[2].index(" turns")] + " turns south near Vienna and ends in a delta",
    ]
    want = [([0], 1), ([1], 0), ([2], 1), ([3], 1), ([4], 1), ([], 0), ([], 0), ([], 0), ([2], 1)]
    for filter_words in (bloom.MOST_WORDS, 1):
        rows = decontaminate.contamination(texts(values), benchmark, filter_words=filter_words).orderBy("doc_id").collect()
        assert [(r.item_ids, r.n_exact) for r in rows] == want


def test_contamination_beyond_ascii(spark, texts):
    items = ["中国的首都是哪一座城市？请写出它的名字。", "เมืองหลวงของประเทศไทยคือเมืองใด", "what colour has the sky", "日本で一番高い山の名前"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    values = [
        "请回答：中国的首都是哪一座城市?请写出它的名字！谢谢", "ถาม" + items[1] + "ครับ", "“what colour has the sky”, they asked", "a what colour has the sky…", "答えは日本で一番高い山の名前です",
        "中国的首都很大，城市的名字很多", "été what côlour has the sky",
    ]
    want = [[0], [1], [2], [2], [3], [], []]
    rows = decontaminate.contamination(texts(values), benchmark).orderBy("doc_id").collect()
    assert [r.item_ids for r in rows] == want


def test_viterbi_with_many_languages():
    rng = np.random.default_rng(3)
    for langs in (129, 200, 300):
        doc, scores = np.repeat([0, 1, 3], [300, 2, 257]), rng.normal(size=(559, langs)) * 3
        scores[:, langs - 30 :] += 2.0  # the high numbers win
        label = language.viterbi(scores, doc, 2.0)
        assert label.min() >= 0 and label.max() < langs
        for d in (0, 1, 3):
            mine, path = scores[doc == d], label[doc == d]
            best = mine[0].copy()
            for row in mine[1:]:
                best = np.maximum(best, best.max() - 2.0) + row
            assert abs(mine[np.arange(len(path)), path].sum() - 2.0 * (np.diff(path) != 0).sum() - best.max()) < 1e-9


def test_long_secrets_are_redacted_to_their_end(texts):
    token = "eyJ" + "aB3_-x9Z.q" * 100
    values = [f"login with token={token}{end}" for end in ("", " and go on", ", then leave", "\nnext")] * 5 + [f"password: none; api_key={'k7' * 70}", "secret:" + "z9" * 200000]
    found = private_data.find(texts(values))
    df = texts(values).join(found.select("doc_id", F.col("spans").alias("found")), "doc_id")
    clean = {r.doc_id: r.c for r in df.select("doc_id", private_data.redact(F.col("text"), F.col("found")).alias("c")).collect()}
    assert [clean[i] for i in range(4)] == ["login with [secret]", "login with [secret] and go on", "login with [secret], then leave", "login with [secret]\nnext"]
    assert clean[20] == "password: none; [secret]" and clean[21] == "[secret]"
