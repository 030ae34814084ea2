"""Secret scan with native functions only: fixed patterns, and the entropy of sliding windows.

Fixed kinds are leftmost non-overlapping matches of ``BASE_KINDS``; matches whose value is too short are dropped.
Entropy kinds: candidates are the runs of a character class of some length. A window slides over each candidate; the
counts of its characters, and with them the sum of c * log2(c), change only by the character that enters and the one
that leaves. Windows at or above the class's threshold (in bits a character) are merged into spans. Candidates that the
allow-list matches are suppressed, and so are spans inside a span of a fixed kind.

Sums are whole millionths, so results do not depend on the order of additions. Positions are code points, ends
exclusive. Null texts count as empty; every row is done by itself, so repeated rows, null ids and further columns do
not matter; texts are never cut; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text

#: Kind, pattern, group whose length counts, least length.
BASE_KINDS = [
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),  # the runs of 24 or more; shorter runs would be dropped anyway
]


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``alphabet`` (``pattern`` as a class) of ``least`` characters are searched with windows of ``width``."""

    kind: str
    alphabet: str
    pattern: str
    least: int
    width: int
    bits: float

    @property
    def limit(self) -> int:
        """The entropy is at the threshold or above where the sum of c * log2(c) is at most this many millionths."""
        return math.floor(self.width * (math.log2(self.width) - self.bits) * 1e6)


LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    EntropyClass("entropy_base64", LETTERS.upper() + LETTERS + "0123456789+/_=-", "[A-Za-z0-9+/_=-]", 24, 20, 3.85),
    EntropyClass("entropy_hex", "0123456789ABCDEFabcdef", "[0-9A-Fa-f]", 24, 24, 3.2),
)
#: Candidates that are no secrets: without a digit (words, paths), identifiers of the UUID form, examples, alphabets.
ALLOW = (
    "^[^0-9]*$",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "(?i:example|sample|placeholder|changeme|dummy)",
    "(?i:abcdefgh)|01234567|12345678",
)
CHUNK = 256


def _appended(steps: Column, begin: Column, move, value) -> Column:
    """Array of ``value(at, x)`` while ``at`` moves by ``move(x)`` from one element to the next."""
    start = F.struct(begin.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(steps, start, lambda acc, x: F.struct(
        (acc["at"] + move(x)).alias("at"), F.concat(acc["out"], F.array(value(acc["at"], x).cast("bigint"))).alias("out")), lambda acc: acc["out"])


def _starts(gaps: Column, lengths: Column) -> Column:
    """Where matches begin, from the lengths between and of them; running sums in chunks keep long lists cheap."""
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), lengths, lambda g, n: F.struct(g.alias("gap"), n.alias("n")))
    move = lambda x: x["gap"] + x["n"]
    chunks = F.transform(F.sequence(F.lit(0), ((F.size(lengths) - 1) / CHUNK).cast("int")), lambda b: F.slice(steps, b * CHUNK + 1, CHUNK))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + move(x)))
    begins = _appended(sums, F.lit(0), lambda s: s, lambda at, s: at)
    return F.flatten(F.zip_with(chunks, begins, lambda c, b: _appended(c, b, move, lambda at, x: at + x["gap"])))


SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _with_matches(df: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """Adds ``name``, the matches, and ``name``_at, where they begin."""
    df = df.withColumn(name, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.size(name) > 0
    return df.withColumn(f"{name}_at", F.when(found, _starts(gaps, F.transform(name, F.length))).otherwise(F.array().cast("array<bigint>")))


def _windows(text: Column, c: EntropyClass) -> Column:
    """Spans (a, b) of the windows of one candidate whose entropy reaches the threshold, merged; a counts from 0."""
    w, weight = c.width, F.array(*[F.lit(round(n * math.log2(n) * 1e6) if n else 0).cast("bigint") for n in range(c.width + 2)])
    codes = F.transform(F.split(text, ""), lambda ch: F.instr(F.lit(c.alphabet), ch) - 1)
    span = "array<struct<a:bigint,b:bigint>>"
    start = F.struct(F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(-1).cast("bigint").alias("a"),
                     F.lit(-1).cast("bigint").alias("b"), F.array().cast(span).alias("done"))
    # each step has the place, the character that enters and the one that leaves (-1: none)
    steps = F.transform(codes, lambda x, i: F.struct((i + 1).cast("bigint").alias("p"), x.alias("x"), F.lit(-1).alias("y")))
    steps = F.zip_with(steps, F.concat(F.array_repeat(F.lit(-1), w), codes), lambda s, y: F.struct(s["p"].alias("p"), s["x"].alias("x"), y.alias("y")))
    steps = F.slice(steps, F.lit(1), F.size(codes))

    def step(acc, s):
        x, y, p = s["x"], s["y"], s["p"]
        n, m = F.get(acc["counts"], x), F.get(acc["counts"], y)
        gain = F.get(weight, n + 1) - F.get(weight, n) - F.when(y >= 0, F.get(weight, m) - F.get(weight, m - 1)).otherwise(F.lit(0))
        total = acc["sum"] + F.when(x == y, F.lit(0).cast("bigint")).otherwise(gain)
        counts = F.transform(acc["counts"], lambda v, i: v + (i == x).cast("int") - (i == y).cast("int"))
        high, low = (p >= w) & (total <= c.limit), p - w
        joins = high & (acc["b"] >= low)
        opens = high & (acc["b"] < low)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(opens, low).otherwise(acc["a"]).alias("a"), F.when(joins | opens, p).otherwise(acc["b"]).alias("b"),
                        F.when(opens & (acc["a"] >= 0), F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(steps, start, step, lambda acc: F.when(acc["a"] >= 0, F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))).otherwise(acc["done"]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per row: id, base (spans of the fixed kinds) and added (entropy spans), as arrays of (start, kind, end)."""
    df = docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col).cast("string")).alias("t"))
    kinds = []
    for k, (_, pattern, group, least) in enumerate(BASE_KINDS):
        df = _with_matches(df, f"m{k}", "t", pattern)
        value = f"v{k}" if group else f"m{k}"
        if group:
            df = df.withColumn(value, F.when(F.size(f"m{k}") > 0, F.regexp_extract_all("t", F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>")))
        kinds.append(_base_spans(k, value, least))
    for k, c in enumerate(classes):
        df = _with_matches(df, f"c{k}", "t", f"{c.pattern}{{{c.least},}}")
    df = df.select("id", F.array_sort(F.concat(*kinds)).alias("base"), *[f"c{k}{x}" for k in range(len(classes)) for x in ("", "_at")])
    df = df.withColumn("added", F.concat(*[_entropy_spans(k, c, allow) for k, c in enumerate(classes)]))
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    return df.select("id", "base", F.filter("added", lambda s: ~inside(s)).alias("added"))


def _base_spans(k: int, value: str, least: int) -> Column:
    rows = F.arrays_zip(F.col(f"m{k}").alias("m"), F.col(f"m{k}_at").alias("at"), F.col(value).alias("v"))
    rows = F.filter(rows, lambda x: F.length(x["v"]) >= least)
    return F.transform(rows, lambda x: F.struct(x["at"].alias("start"), F.lit(k).alias("kind"), (x["at"] + F.length(x["m"])).alias("end"))).cast(SPAN)


def _entropy_spans(k: int, c: EntropyClass, allow: tuple[str, ...]) -> Column:
    rows = F.arrays_zip(F.col(f"c{k}").alias("m"), F.col(f"c{k}_at").alias("at"))
    if allow:
        rows = F.filter(rows, lambda x: ~x["m"].rlike("|".join(f"(?:{p})" for p in allow)))
    kind = F.lit(len(BASE_KINDS) + k)
    spans = F.flatten(F.transform(rows, lambda x: F.transform(_windows(x["m"], c), lambda s: F.struct(
        (x["at"] + s["a"]).alias("start"), kind.alias("kind"), (x["at"] + s["b"]).alias("end")))))
    return F.coalesce(F.when(F.size(f"c{k}") > 0, spans.cast(SPAN)), F.array().cast(SPAN))


def written(spans: Column, classes: tuple[EntropyClass, ...] = CLASSES) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(n) for n in [k[0] for k in BASE_KINDS] + [c.kind for c in classes]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
