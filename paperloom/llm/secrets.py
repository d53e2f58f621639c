"""Operator 6: secret scan by sliding-window entropy (built-in functions only).

Candidate strings are runs of ``[A-Za-z0-9+/_=-]`` of ``window`` characters or
more. A window slides over each; as a character enters and another leaves, the
counts of the characters in it are kept up to date and the sum of ``c * log2(c)``
changes by the two counts concerned, which gives the window's Shannon entropy.
A candidate counts as a secret when its highest entropy reaches the threshold of
its character class (digits, hex, letters, mixed) and no allow-list pattern holds.

Besides, ``RULES`` finds key assignments, access keys and long hex strings by
pattern. Matches are placed by the lengths of the text between them, in code
points.

Edge cases: null text counts as empty; an empty table yields an empty result;
repeated rows are separate rows; texts of any length are scanned whole; spans that
start alike stand by kind, and a tie with a class's least entropy counts as a secret;
other input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Kind, pattern, and the least length of a capturing group (0: the match).
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Patterns that hold wherever a rule's match is long enough, to skip other texts.
QUICK = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]+"
#: Character class, pattern, and least entropy in bits of some window of 20 characters.
#: Running numbers stay below what digits need, long words and most joined ones below letters.
#: Mixed-case letters with padding are mixed, as they are without it.
CLASSES = (
    ("digits", r"^[0-9_=+/-]+$", 3.05),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.93),
    ("letters", r"^(?!(?=[A-Z+/]*[a-z])(?=[a-z+/]*[A-Z])[A-Za-z+/]+={1,2}$)(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[A-Za-z]+(?:[-_/=+]+[A-Za-z]*)+)$", 3.8),
    ("mixed", r"", 3.73),
)
ALLOW = r"(?i)example|sample|placeholder|dummy|changeme|xxxx|1234567890|abcdefghij|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def located(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, e, m>>: code-point ranges of all matches in order whose group is long enough."""
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.regexp_extract_all(text, F.lit(pattern), group).alias("g"))
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))
        return F.struct(F.coalesce(e, acc["at"]).alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def max_entropy(string: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any ``window`` characters of a string of ASCII letters, digits and ``+/_=-``."""
    slot = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    leaving = F.concat(F.array_repeat(F.lit(0), F.lit(window)), slot)
    steps = F.filter(F.arrays_zip(slot.alias("into"), leaving.alias("out")), lambda x: x["into"] > 0)
    table = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    f = lambda c: F.get(table, c)
    zeros = F.array_repeat(F.lit(0), F.lit(len(ALPHABET) + 1))

    def step(acc: Column, x: Column) -> Column:
        into, out, counts = x["into"], x["out"], acc["counts"]
        came, left = F.get(counts, into), F.get(counts, out)
        same = into == out
        moved = F.when(same, acc["total"]).otherwise(acc["total"] + f(came + 1) - f(came) + F.when(out > 0, f(left - 1) - f(left)).otherwise(0.0))
        now = F.when(same, counts).otherwise(F.transform(counts, lambda c, k: c + F.when(k == into, 1).otherwise(0) - F.when((k == out) & (k > 0), 1).otherwise(0)))
        n = acc["n"] + 1
        bits = F.lit(math.log2(window)) - moved / window
        return F.struct(now.alias("counts"), moved.alias("total"), n.alias("n"), F.when(n >= window, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

    start = F.struct(zeros.alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))
    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, classes=CLASSES, allow: str = ALLOW) -> DataFrame:
    """(doc_id, base, spans), one row for each input row: arrays of (kind, s, e, m) by start, then kind."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = lambda name, pattern, group, least, quick: F.when(F.regexp_like("_t", F.lit(quick)), located(F.col("_t"), pattern, group, least)).otherwise(none).alias(name)
    staged = scratch.cut(
        rows.select(
            "doc_id",
            *(found(kind, pattern, group, least, QUICK[kind]) for kind, pattern, group, least in RULES),
            found("_cands", CANDIDATE, 0, window, CANDIDATE[:-1] + f"{{{window}}}"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "matches",
    )
    kinds = [kind for kind, *_ in RULES]
    named = lambda k, kind: F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))
    base = F.array_sort(F.concat(*(named(k, kind) for k, kind in enumerate(kinds))))

    least = F.lit(None).cast("double")
    for _, pattern, bits in reversed(classes):
        here = F.lit(None if bits is None else float(bits)).cast("double")
        least = F.when(F.regexp_like("m", F.lit(pattern)), here).otherwise(least) if pattern else here
    cands = staged.filter(F.size("_cands") > 0).select("_row", F.inline("_cands")).filter(~F.regexp_like("m", F.lit(allow))).withColumn("_least", least)
    high = cands.withColumn("_bits", max_entropy(F.col("m"), window)).filter("_bits >= _least")
    more = high.groupBy("_row").agg(F.collect_list(F.struct("s", F.lit(len(kinds)).alias("k"), "e", F.lit("entropy").alias("kind"), "m")).alias("_more"))
    return (
        staged.withColumn("base", base)
        .select("_row", "doc_id", "base")
        .join(more, "_row", "left")
        .select("doc_id", "base", F.when(F.col("_more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "_more"))).alias("spans"))
    )


def joined(spans: Column | str) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
