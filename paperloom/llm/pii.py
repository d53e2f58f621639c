"""Operator 3: personal data by patterns, extended by bootstrapped contexts.

Base entities (mail and network addresses, card and phone numbers) are found by
their form and are the seeds. A context is what stands right before an entity:
its two preceding words, or the preceding word alone if that ends with ``:``,
``=`` or ``#``. Every identifier-like string (one that holds a digit or ``@``)
after a context is an instance of it. Contexts and instances form a weighted
graph, on which Spark scores in rounds: a context's confidence is the share of
its instances that are known, with one unknown instance added; an instance's is
that of its contexts together (noisy-or over contexts that are accepted).
Accepted contexts (confidence and number of distinct known instances) add the
identifiers that follow them and that no pattern has found.

A document's occurrences stay in one row until contexts are scored; the graph is
aggregated before it is shuffled, and only (context, instance) pairs are joined,
so a frequent context costs as many rows as it has distinct instances.

Edge cases: null text counts as empty; an empty table yields an empty result;
repeated rows are separate rows (their occurrences all count); texts are scanned
whole, and words of any length count whole; spans that start alike stand by kind;
other input columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, map_arrow

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"

# The forms of the base entities.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IDENTIFIER = re.compile(r"\S*[0-9@]\S*")
_WRAP = "\"'()[]{}<>,;:!?.*#$%&|"
_WORD = re.compile(r"\S+")
#: Longer words and instances stand as their length and digest, so that each costs little however often it precedes something.
LONG = 200


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: at each ``@``, the longest run before it that no earlier match holds."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 40 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _named(length: int, digest: str) -> str:
    return f"#{length}:{digest}"


def short(string: str) -> str:
    """Lower-cased; a long one as its length and digest."""
    return string.lower() if len(string) <= LONG else _named(len(string), hashlib.md5(string.encode()).hexdigest())


class Contexts:
    """What stands before places of one text, asked for in rising order."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.begins, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.kept: dict[int, str] = {}  # long words that are whole
        self.open, self.at, self.digest = -1, 0, None  # a long word of which only the beginning precedes

    def _word(self, k: int, end: int) -> str:
        begin = self.begins[k]
        if end - begin <= LONG:
            return self.text[begin:end].lower()
        if end == self.ends[k]:
            if k not in self.kept:
                self.kept = {k: short(self.text[begin:end])}
            return self.kept[k]
        if self.open != k:
            self.open, self.at, self.digest = k, begin, hashlib.md5()
        self.digest.update(self.text[self.at : end].encode())
        self.at = end
        return _named(end - begin, self.digest.copy().hexdigest())

    def before(self, start: int) -> str | None:
        """The words right before ``start``; None at the beginning of a text."""
        k = bisect.bisect_left(self.begins, start) - 1
        if k < 0:
            return None
        end = min(self.ends[k], start)
        last = self._word(k, end)
        if self.text[end - 1] in ":=#":
            return last
        return f"{self._word(k - 1, self.ends[k - 1])} {last}" if k else None


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, context, instance, seed) for base entities and other identifier-like strings."""
    out, k = [], 0
    if base:
        of = Contexts(text)
        for s, _, e in base:
            if c := of.before(s):
                out.append((s, e, c, short(text[s:e]), True))
    of = None
    for m in _IDENTIFIER.finditer(text):
        raw = m[0]
        s = m.start() + len(raw) - len(raw.lstrip(_WRAP))
        e = s + len(raw.strip(_WRAP))
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        if e <= s or (k < len(base) and base[k][0] < m.end()):
            continue
        if any(c in "0123456789@" for c in text[s:e]):
            of = of or Contexts(text)
            if c := of.before(s):
                out.append((s, e, c, short(text[s:e]), False))
    return out


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
_OCCURRENCES = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("context", pa.string()), ("instance", pa.string()), ("seed", pa.bool_())]))


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    spans, seen = [], []
    for text in batch.column(1).to_pylist():
        base = base_entities(text) if text else []
        spans.append([{"s": s, "k": k, "e": e} for s, k, e in base])
        seen.append([dict(zip(("s", "e", "context", "instance", "seed"), x, strict=True)) for x in occurrences(text, base)] if text else [])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), pa.array(seen, _OCCURRENCES)], names=["doc_id", "base", "seen"])


def score_contexts(edges: DataFrame, scratch: Scratch, *, rounds: int = 3, confidence: float = 0.7, support: int = 3) -> DataFrame:
    """(context, confidence) of accepted contexts, from (context, instance, seed, n) edges."""
    graph = scratch.cut(edges.groupBy("context", "instance").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")), "graph")
    known = graph.withColumn("conf", F.col("seed").cast("double"))
    for k in range(rounds):
        contexts = (
            known.groupBy("context")
            .agg((F.sum(F.col("n") * F.col("conf")) / (F.sum("n") + 1)).alias("confidence"), F.count_if(F.col("conf") >= confidence).alias("support"))
            .filter((F.col("confidence") >= confidence) & (F.col("support") >= support))
        )
        contexts = scratch.cut(contexts, f"contexts{k}")
        if k == rounds - 1:
            return contexts.select("context", "confidence")
        reached = graph.join(contexts.select("context", "confidence"), "context").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("_or"))
        known = graph.join(reached, "instance", "left").withColumn("conf", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("_or", F.lit(0.0)))).drop("_or")
    raise ValueError("rounds must be 1 or more")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, confidence: float = 0.7, support: int = 3) -> DataFrame:
    """(doc_id, base, spans), one row for each input row: arrays of (s, k, e) by start, then kind; kind 4 is by context."""
    arrow_ready(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "pii")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, base array<struct<s:int,k:int,e:int>>, seen array<struct<s:int,e:int,context:string,instance:string,seed:boolean>>"
    staged = scratch.cut(map_arrow(texts, _scan, schema).withColumn("_row", F.monotonically_increasing_id()), "scan")
    seen = staged.filter(F.size("seen") > 0).select("_row", F.inline("seen"))
    accepted = score_contexts(seen.groupBy("context", "instance", "seed").agg(F.count(F.lit(1)).alias("n")), scratch, rounds=rounds, confidence=confidence, support=support)
    more = (
        seen.filter(~F.col("seed"))
        .join(accepted, "context", "left_semi")
        .groupBy("_row")
        .agg(F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("k"), "e")).alias("_more"))
    )
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return staged.select("_row", "doc_id", "base").join(more, "_row", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("_more", none))).alias("spans"))


def joined(spans: str):
    kind = F.array(*(F.lit(k) for k in (*KINDS, CONTEXT)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
