"""Operator 9: near-duplicate vectors by NN-descent.

Vectors are normalised in double precision and equal ones collapse to a class
with a count. Each class keeps a list of its ``k`` nearest others found so far.

1. First lists come from random rotations: vectors with the same largest
   coordinate, up to sign, of some rotated parts meet in a bucket (several
   independent tables); large buckets are cut into stretches.
2. Rounds of NN-descent: the neighbours and reverse neighbours of each class are
   compared with each other, and what is nearer than the last on a list takes its
   place, until few lists change. Entries below ``cos(2 * acos(threshold))`` are
   left out: two vectors that both link to a third are never below it.
3. A list is saturated when it is full of links; nearer vectors may then hide links,
   also those that leave the component. Such lists are enlarged to all that there is
   in reach: the components that hold one (dense) meet in blocks every vector that can
   link with one of theirs, told by its distance to the component's pivot. Of these
   lists only the counts are kept, and which components their links join, so that a
   group of n vectors makes n rows for each of its blocks and not n * n.
4. Links are checked in double precision. An audit compares some vectors with all
   others; while its mean recall is below ``recall``, further tables and rounds
   follow, and after ``attempts`` of them all components count as dense.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; so do vectors whose
length is not the table's most common one (of ties the shortest); repeated rows and
equal vectors link with each other; a null id is kept (its component is the smallest
id that is known); ties in cosine stand by id; an empty table yields an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, binary_parts
from .graph import components

K = 16
TABLES = 10
STRETCH = 256
#: Rows of a block that meet at once, and of the largest blocks, of which a component has eight at least.
BLOCK, LARGE = 512, 4096
AUDIT = 200
#: Dense components whose pivots are broadcast at once.
PIVOTS = 4096


def _vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): normalised doubles as bytes, null where a vector can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v else None
                if x is None or not np.isfinite(x).all() or not x.any():
                    out.append(None)
                    continue
                x = x / np.abs(x).max()
                x = x / np.sqrt((x * x).sum())
                out.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, vec binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    raw, _ = binary_parts(column)
    return raw.view(np.float64).reshape(-1, dim)


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[list[pa.Array]]:
    """Columns of stretches of rows with equal values in the first ``keys`` columns, of at most ``most`` rows."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        k = [t.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for x in k:
            new[1:] |= x[1:] != x[:-1]
        begin = np.flatnonzero(new)
        for a, b in zip(begin, np.append(begin[1:], t.num_rows), strict=True):
            if b == t.num_rows:
                while b - a >= most:
                    yield [c.combine_chunks() for c in t.slice(a, most).columns]
                    a += most
                rest = t.slice(a, b - a) if b > a else None
            else:
                for s in range(a, b, most):
                    yield [c.combine_chunks() for c in t.slice(s, min(most, b - s)).columns]
    if rest is not None and rest.num_rows:
        yield [c.combine_chunks() for c in rest.columns]


_EDGES = "u long, v long, sim double"


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v, s = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.float64)))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], names=["u", "v", "sim"])


def _near(ids: np.ndarray, x: np.ndarray, floor: float, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """For each row, its nearest ``k`` others of ``x`` at ``floor`` or more (and above ``least`` of the row)."""
    sim = x @ x.T
    sim[ids[:, None] == ids[None, :]] = -2
    if len(ids) > k:
        cut = np.partition(sim, len(ids) - k, axis=1)[:, len(ids) - k]
        ok = sim >= np.maximum(cut, floor)[:, None]
    else:
        ok = sim >= floor
    if least is not None:
        ok &= sim > least[:, None]
    r, c = np.nonzero(ok)
    return (ids[r], ids[c], sim[r, c]) if len(r) else None


def _seeds(classes: DataFrame, dim: int, n: int, floor: float, tables: range) -> DataFrame:
    """First edges: vectors that meet in a bucket of some table."""
    bits = max(0.0, math.log2(max(1, n) / 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = []
        for t in tables:
            rng = np.random.default_rng([99, t])
            left, parts = bits, []
            while left > 0.5:
                # A part of d coordinates parts vectors in 2 * d ways.
                d = int(min(dim, max(1, round(2 ** min(left, math.log2(2 * dim)) / 2))))
                parts.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :d])
                left -= math.log2(2 * d)
            turns.append((t, parts))
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for t, parts in turns:
                key = np.zeros(len(x), np.int64)
                for p in parts:
                    y = x @ p
                    at = np.abs(y).argmax(1)
                    key = key * (2 * p.shape[1] + 1) + 2 * at + (y[np.arange(len(y)), at] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(key * 1024 + t), batch.column(0), batch.column(1)], names=["key", "id", "vec"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, vec in _runs(batches, 1, STRETCH):
            if len(ids) > 1 and (got := _near(ids.to_numpy(), _matrix(vec, dim), floor, K)):
                yield _edges([got])

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = classes.select("id", "vec").mapInArrow(run, "key long, id long, vec binary")
    return keyed.repartition(parts, "key").sortWithinPartitions("key", F.xxhash64("id", "key")).mapInArrow(meet, _EDGES)


def _lists(edges: DataFrame) -> DataFrame:
    """The ``K`` nearest of each list, each neighbour once."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return best.withColumn("place", place).filter(F.col("place") <= K)


def _descend(lists: DataFrame, classes: DataFrame, dim: int, floor: float, scratch: Scratch) -> tuple[DataFrame, int]:
    """One round: neighbours of neighbours; the new lists and how many entries are new."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("last")).select(F.col("u").alias("id"), F.when(F.col("n") >= K, F.col("last")).otherwise(floor).alias("least"))
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
    reverse = back.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).filter(F.col("place") <= K)
    around = lists.select("u", "v").unionByName(reverse.select("u", "v")).distinct()
    own = lists.select("u").distinct().select("u", F.col("u").alias("v"))
    near = around.unionByName(own).withColumnRenamed("v", "id").join(full, "id", "left").join(classes.select("id", "vec"), "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, least, vec in _runs(batches, 1, 4 * K):
            low = np.nan_to_num(least.to_numpy(zero_copy_only=False).astype(np.float64), nan=floor)
            if len(ids) > 1 and (got := _near(ids.to_numpy(), _matrix(vec, dim), floor, K, low)):
                yield _edges([got])

    found = near.select("u", "id", "least", "vec").repartition(parts, "u").sortWithinPartitions("u", "id").mapInArrow(meet, _EDGES)
    fresh = scratch.cut(found.distinct().join(lists.select("u", "v"), ["u", "v"], "left_anti"), "found")
    new = scratch.cut(_lists(lists.select("u", "v", "sim").unionByName(fresh)), "lists")
    changed = new.join(lists.select("u", "v"), ["u", "v"], "left_anti").count()
    return new, changed


def _exact(pairs: DataFrame, classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """The pairs (u < v) whose cosine in double precision reaches the threshold."""
    both = pairs.join(classes.select(F.col("id").alias("u"), F.col("vec").alias("x")), "u").join(classes.select(F.col("id").alias("v"), F.col("vec").alias("y")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = (_matrix(b.column(2), dim) * _matrix(b.column(3), dim)).sum(1) >= threshold
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["u", "v"])

    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _reaching(placed: DataFrame, dense: DataFrame, dim: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(component, blocks, home, whole, id, copies, vec): for each dense component its own vectors and all others that can link with one of them.

    No vector of a component is further from its pivot (the vector of the smallest
    id) than its radius, so what links with one is within radius and threshold of it.
    """
    members = placed.join(dense, "component")
    pivots = members.filter("id = component").select("component", F.col("vec").alias("pivot"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((_matrix(b.column(1), dim) * _matrix(b.column(2), dim)).sum(1))], names=["component", "cosine"])

    widths = members.join(pivots, "component").select("component", "vec", "pivot").mapInArrow(spread, "component long, cosine double").groupBy("component").agg(F.min("cosine").alias("cosine"), F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(BLOCK), F.least(F.lit(LARGE), F.count(F.lit(1)) / 8))).cast("int").alias("blocks"))
    pivots = scratch.cut(pivots.join(widths, "component"), "pivots")
    chunks = math.ceil(pivots.count() / PIVOTS)
    flagged = placed.join(dense.withColumn("whole", F.lit(True)), "component", "left").select("id", "component", "copies", F.coalesce("whole", F.lit(False)).alias("whole"), "vec")
    out = None
    for chunk in range(chunks):
        rows = pivots.filter(F.pmod(F.xxhash64("component"), F.lit(chunks)) == chunk).collect()
        angle = np.arccos(np.clip([r.cosine for r in rows], -1, 1)) + math.acos(threshold)
        low = np.where(angle < math.pi, np.cos(np.minimum(angle, math.pi)), -2) - 1e-6
        of = np.array([r.component for r in rows], np.int64), np.array([r.blocks for r in rows], np.int32)
        shared = placed.sparkSession.sparkContext.broadcast((*of, np.array([np.frombuffer(bytes(r.pivot), np.float64) for r in rows]).reshape(-1, dim), low))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = ["component", "blocks", "home", "whole", "id", "copies", "vec"]
            component, blocks, pivot, low = shared.value
            for b in batches:
                r, c = np.nonzero(_matrix(b.column(4), dim) @ pivot.T >= low)
                for k in range(0, len(r), 20_000):
                    some = b.take(pa.array(r[k : k + 20_000]))
                    at = c[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(component[at]), pa.array(blocks[at]), some.column(1), some.column(3), some.column(0), some.column(2), some.column(4)], names=names)

        found = flagged.mapInArrow(run, "component long, blocks int, home long, whole boolean, id long, copies long, vec binary")
        out = found if out is None else out.unionByName(found)
    return out


def _block_counts(reaching: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(id, links, home, component): parts of the links with vectors of dense components; blocks meet, counts are kept.

    ``component`` is set where a vector of another component (``home``) links.
    """
    parts = int(reaching.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = reaching.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = rows.select("component", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(1).alias("side"), "home", "whole", "id", "copies", "vec")
    holds = rows.filter("home = component").select("component", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(0).alias("side"), "home", "whole", "id", "copies", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "links", "home", "component"]
        key, held = None, []
        for comp, i, j, side, home, whole, ids, copies, vec in _runs(batches, 4, BLOCK):
            here = (comp[0].as_py(), i[0].as_py(), j[0].as_py())
            if here != key:
                key, held = here, []
            x, ids_, n = _matrix(vec, dim), ids.to_numpy(), copies.to_numpy()
            if side[0].as_py() == 0:
                held.append((x, ids_, n))
                continue
            total = np.zeros(len(x), np.int64)
            # Vectors of dense components ask themselves; for others both ends are counted here.
            once = np.where(whole.to_numpy(zero_copy_only=False), 0, n)
            for y, other, m in held:
                hit = (x @ y.T >= threshold) & (ids_[:, None] != other[None, :])
                total += hit @ m
                back = once @ hit
                if back.any():
                    none = pa.nulls(int((back > 0).sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(other[back > 0]), pa.array(back[back > 0]), none, none], names=names)
            some = pa.array(total > 0)
            outside = home.to_numpy() != here[0]
            joins = pa.array(np.full(len(x), here[0], np.int64), mask=~outside)
            yield pa.RecordBatch.from_arrays([ids.filter(some), pa.array(total).filter(some), home.filter(some), joins.filter(some)], names=names)

    meets = asks.unionByName(holds).repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "id")
    return meets.mapInArrow(run, "id long, links long, home long, component long")


def _counted(placed: DataFrame, dense: DataFrame, links: DataFrame, dim: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(id, component, copies, least, links): links of lists, in full for dense components, which links join to others."""
    ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(placed.select(F.col("id").alias("v"), "copies"), "v")
    listed = ends.groupBy("u").agg(F.sum("copies").alias("listed")).withColumnRenamed("u", "id")
    out = placed.select("id", "component", "copies", "least").join(listed, "id", "left")
    if dense.isEmpty():
        return scratch.cut(out.withColumn("links", F.coalesce("listed", F.lit(0))).drop("listed"), "counted")
    met = scratch.cut(_block_counts(_reaching(placed, dense, dim, threshold, scratch), dim, threshold), "met")
    joined = components(met.filter("component is not null").select(F.col("home").alias("u"), F.col("component").alias("v")), scratch)
    out = out.join(met.groupBy("id").agg(F.sum("links").alias("met")), "id", "left").join(dense.withColumn("whole", F.lit(True)), "component", "left")
    # Lists hold links within components only, so those with dense components come on top.
    full = F.coalesce("met", F.lit(0)) + F.when(F.col("whole"), 0).otherwise(F.coalesce("listed", F.lit(0)))
    out = out.join(joined.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left")
    return scratch.cut(out.select("id", F.coalesce("joined", "component").alias("component"), "copies", "least", full.alias("links")), "counted")


def _audit(classes: DataFrame, counted: DataFrame, dim: int, threshold: float) -> float:
    """Mean share of their true links that were found, over audited classes that have links.

    Audited are ``AUDIT`` classes and as many with links found, those of the smallest hash of their id.
    """
    first = lambda rows: rows.orderBy(F.xxhash64("id"), "id").limit(AUDIT)
    picked = first(counted.select("id", "links")).unionByName(first(counted.filter("links > 0").select("id", "links"))).distinct()
    sample = classes.select("id", "vec").join(picked, "id").collect()
    if not sample:
        return 1.0
    ids = np.array([r.id for r in sample])
    x = np.stack([np.frombuffer(bytes(r.vec), np.float64) for r in sample])
    shared = classes.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        total = np.zeros(len(own), np.int64)
        for b in batches:
            hit = (q @ _matrix(b.column(1), dim).T >= threshold) & (own[:, None] != b.column(0).to_numpy()[None, :])
            total += hit @ b.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], names=["id", "links"])

    true = classes.select("id", "vec", "copies").mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")).collect()
    want = {r.id: r.links for r in true}
    shares = [min(r.links, want[r.id]) / want[r.id] for r in sample if want.get(r.id)]
    return sum(shares) / len(shares) if shares else 1.0


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, rounds: int = 4, recall: float = 0.98, attempts: int = 3, report: Callable[[float], None] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row; ``report`` gets the audited recall."""
    spark = rows.sparkSession
    arrow_ready(spark)
    scratch = Scratch(spark, "vectors")
    vectors = scratch.cut(_vectors(rows, id_col, vec_col), "vectors")
    common = vectors.filter("vec is not null").groupBy(F.octet_length("vec").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    dim = common.bytes // 8 if common else 1
    fit = F.when(F.octet_length("vec") == 8 * dim, F.col("vec"))
    keyed = vectors.select("vec_id", fit.alias("vec")).withColumn("key", F.xxhash64("vec", F.md5("vec")))
    classes = scratch.cut(keyed.filter("vec is not null").groupBy("vec").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "classes")
    n = classes.count()
    floor = 2 * threshold * threshold - 1 - 1e-9
    lists = counted = labels = None
    for attempt in range(attempts):
        seeds = _seeds(classes, dim, n, floor, range(attempt * TABLES, (attempt + 1) * TABLES))
        known = seeds if lists is None else seeds.unionByName(lists.select("u", "v", "sim"))
        lists = scratch.cut(_lists(known), "lists")
        size = lists.count()
        for _ in range(rounds):
            lists, changed = _descend(lists, classes, dim, floor, scratch)
            if changed <= 0.002 * size:
                break
        near = lists.filter(F.col("sim") >= threshold - 1e-6).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = scratch.cut(_exact(near, classes, dim, threshold), "links")
        labels = components(links, scratch)
        placed = scratch.cut(classes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
        saturated = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("last")).filter((F.col("n") >= K) & (F.col("last") >= threshold - 1e-6)).select(F.col("u").alias("id"))
        dense = scratch.cut(placed.join(saturated, "id", "left_semi").select("component").distinct(), "dense")
        counted = _counted(placed, dense, links, dim, threshold, scratch)
        share = _audit(classes, counted, dim, threshold)
        if report:
            report(share)
        if share >= recall:
            break
    else:
        # The descent has not got there: all components meet all that they can link with, which is exact.
        counted = _counted(placed, placed.select("component").distinct(), links, dim, threshold, scratch)
        if report:
            report(_audit(classes, counted, dim, threshold))
    scratch.keep(vectors, counted)
    first = counted.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = counted.join(first, "component").select("id", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    joined = keyed.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("key")).alias("id")).join(of_class, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
