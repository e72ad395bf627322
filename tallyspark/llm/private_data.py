"""Personal data in whole texts by weak supervision, in DataFrame functions only.

Candidates are what the base patterns match (see BASE; a match must pass its check), what they match
without passing, and what the looser patterns of LOOSE match. Five labelers vote on each: yes, no or
nothing. They look at the strict check, at gazetteers (domains, issuers, calling codes, key prefixes),
at cue words in the text before, at the shape of the value, and at what surrounds it.

Expectation-maximisation on the counts of vote patterns, a table whose size does not depend on the data,
estimates for each kind how often candidates are real and how reliable each labeler is. The posterior of
each pattern then serves as label for the final span classifier, naive Bayes over the labelers' evidence
and discretised features. It decides on the candidates that are not base matches; accepted ones that do
not overlap a base span join the spans. Base spans always stay.

Everything happens in the row of a document; only the counts leave it. Null reads as empty. Offsets are
code points, ends exclusive. Texts of any length are read whole: patterns never start twice inside one run
of characters, and the work on matches grows as their number times its logarithm. Repeated rows give repeated results. Without
candidates (or rows) the model is empty and only base spans count.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.textkit import settle

KINDS = ("email", "ip", "card", "phone", "secret")
# Patterns of the base kinds. Lookbehinds and possessive repeats change no match: a match starts where its run
# of characters starts, or where the match before ended. Card runs of under 12 digits fail their check anyway.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[a-z0-9-]{1,63}+ ?(?:[\[(]dot[\])]|\.) ?[a-z]{2,24}",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api_?key)[=:][^\s,;]{6,}+)",
}
# A character that every match of a pattern has, so that most texts need no search.
_NEEDS = {"email": "@", "phone": "+"}
BLOCK = 1024  # Characters of a block when a text is put together again.
# Gazetteers and cue words.
DOMAINS = "com org net edu gov io info biz co de fr es uk us eu ch at nl it".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|ping|login",
    "card": "card|visa|mastercard|amex|credit|pay|karte|tarjeta|carte",
    "phone": "phone|call|tel|fax|mobile|dial|contact",
    "secret": "key|pass|secret|token|login|aws",
}
AGAINST = "version|release|isbn|issn|page|chapter|section|order|invoice|ticket|serial|sku|doi"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, size: Column, op: Callable[[Column, Column], Column], start: int) -> Column:
    """Running results of an associative ``op`` over an array of ints, by doubling: each round joins entries twice as far apart.

    It takes a logarithm of the size in rounds, each of them linear; ``start`` is the neutral value.
    """
    rounds = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k) < size)

    def step(state: Column, k: Column) -> Column:
        back = F.array_repeat(F.lit(start), F.pow(F.lit(2), k).cast("int"))
        return F.zip_with(F.slice(F.concat(back, state), 1, F.size(state)), state, lambda a, b: op(a, b))

    return F.aggregate(rounds, values, step)


def _spans(text: Column, pattern: str, kind: str, needs: str | None) -> Column:
    """Array of (kind, start, end, value, before, after) of the leftmost non-overlapping matches."""
    kind_no = KINDS.index(kind)
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,value:string,before:string,after:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zipped = F.zip_with(found, F.zip_with(F.slice(between, 1, F.size(found)), F.slice(between, 2, F.size(found)), lambda b, a: F.struct(b.alias("before"), a.alias("after"))), lambda v, x: F.struct(v.alias("value"), x["before"].alias("before"), x["after"].alias("after")))

    def placed(matches: Column) -> Column:
        ends = running(F.transform(matches, lambda x: F.length(x["before"]) + F.length(x["value"])), F.size(matches), lambda a, b: a + b, 0)
        return F.zip_with(matches, ends, lambda x, end: F.struct(
            F.lit(kind_no).alias("kind"), (end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"),
            F.lower(F.right(x["before"], F.lit(48))).alias("before"), F.left(x["after"], F.lit(1)).alias("after"),
        ))

    listed = bound(zipped, placed)
    might = text.contains(needs) if needs else text.rlike(pattern)
    return F.when(might, listed).otherwise(empty)


def _passes(x: Column) -> Column:
    """The check of the base kinds."""
    digits = F.regexp_replace(x["value"], "[^0-9]", "")
    parts = F.forall(F.split(x["value"], r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("decimal(38,0)") <= 255, F.lit(False)))
    size = F.length(digits)
    return (
        F.when(x["kind"] == 0, F.lit(True)).when(x["kind"] == 1, parts)
        .when(x["kind"] == 2, size.between(12, 19) & F.call_function("luhn_check", digits))
        .when(x["kind"] == 3, size.between(9, 15)).otherwise(F.lit(False))
    )


def _any_of(value: Column, words: str) -> Column:
    return value.rlike(f"(?:{words})")


def _votes(x: Column, strict: bool) -> list[Column]:
    """1 yes, -1 no, 0 nothing, by five labelers."""
    digits = F.regexp_replace(x["value"], "[^0-9]", "")
    size = F.length(digits)
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    check = F.when(_passes(x), yes).otherwise(no) if strict else none
    gazetteer = (
        F.when(x["kind"] == 0, F.when(_any_of(F.lower(x["value"]), rf"[.\])] ?(?:{'|'.join(DOMAINS)})$"), yes).otherwise(no))
        .when(x["kind"] == 1, F.when(x["value"].rlike(r"^(?:0|127|224|255)\."), no).otherwise(none))
        .when(x["kind"] == 2, F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[4-7]|6011|65)"), yes).otherwise(no))
        .when(x["kind"] == 3, F.when(x["value"].rlike(rf"^(?:\+(?:{'|'.join(CALLING_CODES)})(?![0-9]{{3}}$)|\(?[2-9])"), yes).otherwise(no))
        .otherwise(F.when(x["value"].rlike("^AKIA"), yes).otherwise(none))
    )
    cue = none
    for i, kind in enumerate(KINDS):
        cue = F.when((x["kind"] == i) & _any_of(x["before"], CUES[kind]), yes).otherwise(cue)
    context = F.when(x["before"].rlike(rf"(?:{AGAINST})\W*$"), no).otherwise(cue)
    flat = digits.rlike(r"^(\d)\1*$")
    shape = (
        F.when(x["kind"] == 0, F.when(F.length(x["value"]) <= 80, yes).otherwise(no))
        .when(x["kind"] == 1, F.when(x["value"].rlike(r"(?:^|\.)0[0-9]"), no).otherwise(yes))
        .when(x["kind"] == 2, F.when(flat | ~size.between(13, 19), no).otherwise(yes))
        .when(x["kind"] == 3, F.when(flat | ~size.between(9, 15), no).otherwise(yes))
        .otherwise(F.when(x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"), yes).otherwise(no))
    )
    around = F.when(x["before"].rlike(r"[\p{L}0-9_/=]$") | x["after"].rlike(r"[\p{L}0-9_/@]"), no).otherwise(yes)
    return [check, gazetteer, context, shape, around]


def _judged(x: Column, strict: bool) -> Column:
    votes = _votes(x, strict)
    size = F.least(F.floor(F.length(x["value"]) / 6), F.lit(9)).cast("int")
    before = F.when(x["before"] == "", 0).when(x["before"].rlike(r"\s$"), 1).when(x["before"].rlike(r"[\p{L}0-9]$"), 2).otherwise(3)
    after = F.when(x["after"] == "", 0).when(x["after"].rlike(r"\s"), 1).when(x["after"].rlike(r"[\p{L}0-9]"), 2).otherwise(3)
    return F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (_passes(x) if strict else F.lit(False)).alias("base"),
        F.concat_ws(",", *[v.cast("string") for v in votes]).alias("votes"), F.concat_ws(",", size.cast("string"), before.cast("string"), after.cast("string")).alias("traits"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row: all candidates with their votes and traits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", text.alias("text"))
    strict = plain.select("doc_id", *[_spans(F.col("text"), p, k, _NEEDS.get(k)).alias(f"base_{k}") for k, p in BASE.items()], *[_spans(F.col("text"), p, k, None).alias(f"loose_{k}") for k, p in LOOSE.items()])
    judged = [F.transform(f"base_{k}", lambda x: _judged(x, True)) for k in BASE] + [F.transform(f"loose_{k}", lambda x: _judged(x, False)) for k in LOOSE]
    return strict.select("doc_id", F.concat(*judged).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 50) -> dict[int, tuple[float, list[dict[int, tuple[float, float]]]]]:
    """For each kind the share of real candidates, and for each labeler the chance of each vote on real and on other ones.

    ``patterns`` are (kind, votes, count). Voting starts as if each labeler were right four times out of five.
    """
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        labelers = len(rows[0][0])
        share, chance = 0.5, [{1: (0.6, 0.15), 0: (0.25, 0.25), -1: (0.15, 0.6)} for _ in range(labelers)]
        for _ in range(rounds):
            real = [(v, n, posterior(v, share, chance)) for v, n in rows]
            yes = sum(n * p for _, n, p in real)
            total = sum(n for _, n, _ in real)
            share = min(max((yes + 1) / (total + 2), 1e-3), 1 - 1e-3)
            chance = [
                {
                    vote: (
                        (sum(n * p for v, n, p in real if v[i] == vote) + 2 * prior[0]) / (yes + 2),
                        (sum(n * (1 - p) for v, n, p in real if v[i] == vote) + 2 * prior[1]) / (total - yes + 2),
                    )
                    for vote, prior in {1: (0.6, 0.15), 0: (0.25, 0.25), -1: (0.15, 0.6)}.items()
                }
                for i in range(labelers)
            ]
        out[kind] = (share, chance)
    return out


def posterior(votes: tuple[int, ...], share: float, chance: list[dict[int, tuple[float, float]]]) -> float:
    score = math.log(share / (1 - share)) + sum(math.log(c[v][0] / c[v][1]) for v, c in zip(votes, chance, strict=True))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))


def train(found: DataFrame) -> dict[str, float]:
    """Log-odds of the span classifier: one weight for each kind, and for each kind and vote or trait."""
    # Kinds, votes and traits have few values each, so this table is small whatever the input.
    counts = found.select(F.inline("spans")).groupBy("kind", "votes", "traits").agg(F.count("*").alias("n")).collect()
    rows = [(r.kind, tuple(map(int, r.votes.split(","))), r.traits.split(","), float(r.n)) for r in counts]
    patterns: dict[tuple, float] = {}
    for kind, votes, _, n in rows:
        patterns[kind, votes] = patterns.get((kind, votes), 0.0) + n
    model = reliabilities([(k, v, n) for (k, v), n in patterns.items()])
    sums: dict[str, list[float]] = {}
    for kind, votes, traits, n in rows:
        p = posterior(votes, *model[kind])
        names = [f"{kind}"] + [f"{kind}|v{i}|{v}" for i, v in enumerate(votes)] + [f"{kind}|t{i}|{t}" for i, t in enumerate(traits)]
        for name in names:
            cell = sums.setdefault(name, [0.0, 0.0])
            cell[0] += n * p
            cell[1] += n * (1 - p)
    weights = {}
    for name, (yes, no) in sums.items():
        kind = name.split("|")[0]
        all_yes, all_no = sums[kind]
        weights[name] = math.log((all_yes + 1) / (all_no + 1)) if "|" not in name else math.log((yes + 1) / (all_yes + 2)) - math.log((no + 1) / (all_no + 2))
    return weights


def _label(s: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: arrays of (start, kind, end) in order, for every row of ``doc_id, text``."""
    found = settle(candidates(docs))
    weights = train(found)
    table = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(w))]) if weights else F.create_map().cast("map<string,double>")

    def odds(x: Column) -> Column:
        kind = x["kind"].cast("string")
        names = F.concat(
            F.array(kind), F.transform(F.split(x["votes"], ","), lambda v, i: F.concat(kind, F.lit("|v"), i.cast("string"), F.lit("|"), v)),
            F.transform(F.split(x["traits"], ","), lambda t, i: F.concat(kind, F.lit("|t"), i.cast("string"), F.lit("|"), t)),
        )
        return F.aggregate(names, F.lit(0.0), lambda s, n: s + F.coalesce(F.try_element_at("weights", n), F.lit(0.0)))

    def plain(column: Column) -> Column:
        return F.array_sort(F.transform(column, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))

    base = found.select("doc_id", "spans", F.filter("spans", lambda x: x["base"]).alias("base"), table.alias("weights"))
    limit = math.log(threshold / (1 - threshold))
    likely = F.filter("spans", lambda x: ~x["base"] & (odds(x) > limit))
    judged = base.select("doc_id", plain(F.col("base")).alias("base"), plain(likely).alias("extra"))
    return judged.select("doc_id", "base", F.array_sort(F.concat("base", _apart(F.col("extra"), F.col("base")))).alias("spans"))


def _apart(extra: Column, base: Column) -> Column:
    """The extra spans that overlap no base span, in one sweep over both in order of their starts.

    Such a span starts at or after the ends of the base spans before it, and ends at or before the start of the next one.
    """
    far = 2**31 - 1
    both = F.array_sort(F.concat(
        F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("turn"), x["kind"].alias("kind"), x["end"].alias("end"))),
        F.transform(extra, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("turn"), x["kind"].alias("kind"), x["end"].alias("end"))),
    ))

    def sweep(rows: Column) -> Column:
        ended = running(F.transform(rows, lambda x: F.when(x["turn"] == 0, x["end"]).otherwise(F.lit(0))), F.size(rows), F.greatest, 0)
        starts = F.transform(F.reverse(rows), lambda x: F.when(x["turn"] == 0, x["start"]).otherwise(F.lit(far)))
        due = F.reverse(running(starts, F.size(rows), F.least, far))
        marked = F.zip_with(rows, F.zip_with(ended, due, lambda a, b: F.struct(a.alias("ended"), b.alias("due"))), lambda x, w: F.struct(
            x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"),
            ((x["turn"] == 1) & (w["ended"] <= x["start"]) & (x["end"] <= w["due"])).alias("free"),
        ))
        return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when((F.size(base) == 0) | (F.size(extra) == 0), extra).otherwise(bound(both, sweep))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced once, by the first.

    The text is cut into blocks once, and what lies between two spans is put together from the blocks it touches.
    """
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(cut: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        touched = F.array_join(F.slice(cut, first + 1, F.ceil(end / BLOCK).cast("int") - first), "")
        return F.when(end > start, F.substring(touched, start - first * BLOCK + 1, end - start)).otherwise("")

    def join(cut: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), F.size(spans), F.greatest, 0)
        # What lies before each span begins where all spans before it have ended; the last entry is the end of the text.
        total = F.length(text)
        starts = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("name"))), F.array(F.struct(total.alias("start"), F.lit("").alias("name"))))
        pieces = F.zip_with(starts, F.concat(F.array(F.lit(0)), ends), lambda s, at: F.when(s["start"] >= at, F.concat(between(cut, at, s["start"]), s["name"])).otherwise(""))
        return F.array_join(pieces, "")

    return F.when(F.size(spans) > 0, bound(blocks, join)).otherwise(text)


def report(found: DataFrame) -> DataFrame:
    """Counts and texts of the spans of ``find``."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    def joined(column: str) -> Column:
        return F.concat_ws(",", F.transform(column, _label))

    return found.select("doc_id", count("email"), count("ip"), count("card"), count("phone"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
