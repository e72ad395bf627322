"""Private data in texts with very many matches: same spans as a plain search, and time that does not grow with their square."""

import random
import time

from pyspark.sql import functions as F

from tallyspark.llm import private_data as pd


def test_running_results(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(50) for _ in range(n)],) for n in (0, 1, 2, 3, 7, 8, 9, 100)]
    df = spark.createDataFrame(rows, "v array<int>")
    out = df.select("v", pd.running(F.col("v"), F.size("v"), lambda a, b: a + b, 0).alias("s"), pd.running(F.col("v"), F.size("v"), F.greatest, 0).alias("m")).collect()
    for r in out:
        assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))] and r.m == [max(r.v[: i + 1]) for i in range(len(r.v))]


def test_spans_that_overlap_no_base_span(spark):
    rng = random.Random(2)

    def spans(n):
        out = []
        for _ in range(n):
            start = rng.randrange(200)
            out.append((start, rng.randrange(5), start + rng.randrange(1, 12)))
        return sorted(set(out))

    rows = [(i, spans(rng.randrange(12)), spans(rng.randrange(12))) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, base array<struct<start:int,kind:int,end:int>>, extra array<struct<start:int,kind:int,end:int>>")
    for r in df.select("*", pd._apart(F.col("extra"), F.col("base")).alias("free")).collect():
        want = [x for x in r.extra if not any(b.start < x.end and x.start < b.end for b in r.base)]
        assert [tuple(x) for x in r.free] == [tuple(x) for x in want]


def test_redacted_text_equals_plain_cuts(spark):
    rng = random.Random(3)
    rows = []
    for i, size in enumerate((0, 1, 1023, 1024, 1025, 5000, 9000)):
        text = "".join(rng.choice("abc é中\n😀") for _ in range(size))
        for many in (0, 1, 40):
            starts = sorted(rng.randrange(size) for _ in range(many)) if size else []
            rows.append((i, text, [(s, rng.randrange(5), min(size, s + rng.randrange(1, 30))) for s in starts]))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,kind:int,end:int>>")
    for r in df.select("*", pd.redact(F.col("text"), F.col("spans")).alias("out")).collect():
        want, at = "", 0
        for s in r.spans:
            if s.start >= at:
                want += r.text[at : s.start] + f"[{pd.KINDS[s.kind]}]"
            at = max(at, s.end)
        assert r.out == want + r.text[at:]


def test_many_matches_in_one_text(spark):
    def run(n):
        text = " ".join(f"user{i}@host{i % 7}.com or call +49 30 {1000000 + i}," for i in range(n))
        found = pd.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))
        began = time.perf_counter()
        row = found.select(F.size("base").alias("n"), F.element_at("base", -1).alias("last"), pd.redact(F.lit(text), F.col("spans")).alias("clean")).first()
        spent = time.perf_counter() - began
        assert row.n == 2 * n and row.last.end == len(text) - 1 and row.clean.count("[email]") == row.clean.count("[phone]") == n
        return spent

    run(500)
    few, many = min(run(4000) for _ in range(2)), run(8000)
    assert many < 2.5 * few + 1.0
