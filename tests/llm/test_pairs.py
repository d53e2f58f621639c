"""Operators on pairs: Jaccard join, decontamination, near vectors, and the pipeline."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import decontamination, graph, jaccard, neighbours, stages, textcode
from paperloom.llm.common import Scratch

DATA = "/root/testdata/sf0.001"


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    low = list(range(len(texts)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(seed):
    random.seed(seed)
    words = ["w%d" % k for k in range(300)]
    base = random.choices(words, k=120)
    texts = [None, "", " ", "one", "One", "two words", "a b c d"]
    for k in range(120):  # one large group of near copies, more and less edited
        t = base[:]
        for _ in range(k % 9):
            t[random.randrange(len(t))] = random.choice(words)
        texts.append(" ".join(t))
    common = " ".join(random.choices(words, k=30))
    for _ in range(40):  # a passage that many texts share
        texts.append(common + " " + " ".join(random.choices(words, k=random.randint(0, 40))))
    texts += [texts[20]] * 15 + ["big " * 4000]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, frame, seed):
    texts = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(frame(texts).repartition(5)).collect()}
    assert got == brute_classes(texts)


def brute_near_copies(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    low = list(range(len(texts)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_near_copies_of_the_pipeline_against_brute_force(spark, frame):
    random.seed(9)
    texts = near_copies(9)
    for cut in (81, 83, 84, 79):  # the long document's copy ends early
        long = ["u%d" % random.randrange(10_000) for _ in range(504)]
        texts += [" ".join(long), " ".join(long[: 4 + 5 * cut])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(frame(texts), k=5, threshold=(80, 100)).collect()}
    want = brute_near_copies(texts, 5, 80)
    assert got == want
    kept = {r.doc_id for r in stages.one_of_each_group(spark, frame(texts), "").collect()}
    assert kept == {k for k, (_, low) in want.items() if k == low}


@pytest.mark.parametrize("th", [(85, 100), (80, 100), (1, 2)])
def test_linked_classes_meet_early_in_their_prefixes(spark, frame, th):
    random.seed(31)
    texts = [t for t in near_copies(5) if t] + ["%d %d %d %d" % (k % 3, k % 5, 7, 8) for k in range(30)] + ["tail " + " ".join("m%d" % random.randrange(40) for _ in range(random.randint(3, 30))) for _ in range(60)]
    limit, rows = jaccard.Threshold(*th), jaccard._texts(frame(texts).repartition(3), "doc_id", "text")
    sets = {jaccard.set_code(x): set(x.tolist()) for x in textcode.shingle_sets([t.encode() for t in texts], 4) if len(x)}
    for hot in (0, 40):  # without and with codes noted as frequent
        table = np.zeros(1 << jaccard.TABLE_BITS, np.uint8)
        for code in sorted(c for x in sets.values() for c in x)[: hot * 20 : 20]:
            table[int(textcode.mixed(np.array([code], np.uint64))[0]) & ((1 << jaccard.TABLE_BITS) - 1)] = 3
        drawn = jaccard._drawn_rows(rows, spark.sparkContext.broadcast(table), limit, 4, 0).repartition(3, "code").sortWithinPartitions("code", "np", "cls")
        prefix = {}
        for r in jaccard._prefix_rows(Scratch(spark, "t").cut(jaccard._shared_rows(drawn), "held"), limit).collect():
            assert r.np >> 32 == len(sets[r.cls])
            prefix.setdefault(r.cls, {})[r.code] = r.np & 0xFFFFFFFF
        for cls, at in prefix.items():
            assert len(set(at.values())) == len(at) and max(at.values()) < limit.prefix(len(sets[cls]))
        linked = 0
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and th[1] * len(x & y) >= th[0] * len(x | y):
                    linked += 1
                    both = prefix.get(a, {}).keys() & prefix.get(b, {}).keys()
                    assert any(jaccard._early(limit, len(x), prefix[a][c], len(y), prefix[b][c]) for c in both)
        assert linked > 50


def test_counts_of_long_runs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MANY", 50)
    random.seed(12)
    rows = [(code, cls, (9 << 32) | cls % 4) for code, n in ((1, 1), (2, 2), (3, 49), (4, 50), (5, 51), (6, 400), (7, 1), (8, 130), (9, 3)) for cls in range(n) for _ in range(1 + (cls % 7 == 0))]
    random.shuffle(rows)
    for batch in (7, 64, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        df = spark.createDataFrame(rows, "code long, cls long, np long").coalesce(1).sortWithinPartitions("code", "np", "cls")
        got = {}
        for r in jaccard._shared_rows(df).collect():
            got.setdefault(r.code, []).append((r.cls, r.level))
        assert {c: sorted(x for x, _ in v) for c, v in got.items()} == {c: list(range(n)) for c, n in ((2, 2), (3, 49), (4, 50), (5, 51), (6, 400), (8, 130), (9, 3))}
        for c, n in ((2, 2), (9, 3)):
            assert {level for _, level in got[c]} == {int(np.ceil(np.log2(n)))}
        assert all(len({level for _, level in v}) == 1 for v in got.values())


def test_jaccard_edges(spark, frame):
    assert jaccard.similarity_classes(frame(["x"]).limit(0)).count() == 0
    r = jaccard.similarity_classes(frame(["a b c d e", "a b c d e", "x"], ids=[None, 4, None])).collect()
    assert sorted((x.doc_id is None, x.n_shingles, x.component_id) for x in r if x.n_shingles == 2) == [(False, 2, 4), (True, 2, 4)]


def test_white_space_after_words_does_not_count(spark, frame):
    words = ["foo", "bar", "x" * 64, "y" * 65, "é", "last"]
    plain, wide = " ".join(words), (" " * 100).join(words)
    texts = [plain, wide, "\n" * 70 + plain + "\t" * 90, plain, *[None, ""] * 50, " " * 80 + plain]
    for some in (texts, texts[:1], [wide + " " + plain]):
        codes, bounds = textcode.token_codes([(t or "").encode() for t in some])
        runs = [codes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        alone = textcode.token_codes([plain.encode()])[0].tolist()
        assert all(r in ([], alone, alone * 2) for r in runs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(frame(texts).coalesce(1)).collect()}
    assert got == brute_classes(texts)


def test_components(spark):
    random.seed(4)
    edges = [(k, k + 1) for k in range(200) if k % 10] + [(random.randrange(1000, 1100), random.randrange(1000, 1100)) for _ in range(60)]
    low = {}

    def find(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        low[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.node: r.component for r in graph.components(df, Scratch(spark, "test")).collect()}
    assert all(got.get(x, x) == find(x) for x in low)


def test_tiles_catch_reordered_passages():
    item = list(range(40))
    doc = [90, *item[20:40], 91, 92, *item[0:20], 93]
    assert sum(n for *_, n in decontamination.tiles(item, doc)) == 40
    assert decontamination.tiles(item, [99] * 50) == []
    assert sum(n for *_, n in decontamination.tiles([1] * 12, [1] * 30)) == 12
    tiles = decontamination.tiles(item, item[:10] + [77] + item[5:25])
    used = [p for p, _, n in tiles for p in range(p, p + n)]
    assert len(used) == len(set(used)) and max(n for *_, n in tiles) == 20


def brute_coverage(item, text, least=5):
    """Greedy string tiling as defined: again and again the longest common run of unmarked words."""
    p, d = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for x in (item, text)]
    if not p:
        return 0.0
    least = min(least, len(p))
    done_p, done_d, total = [False] * len(p), [False] * len(d), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(d)):
                k = 0
                while i + k < len(p) and j + k < len(d) and p[i + k] == d[j + k] and not done_p[i + k] and not done_d[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total / len(p)
        done_p[i : i + k] = [True] * k
        done_d[j : j + k] = [True] * k
        total += k


def test_decontamination(spark, frame):
    random.seed(6)
    words = ["v%d" % k for k in range(500)]
    items = [" ".join(random.choices(words, k=30)) for _ in range(8)] + ["three word item", None, "", "ha " * 12]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    split = items[0].split()
    clean = " ".join(random.choices(words, k=4000))
    texts = [None, "", clean, clean + " " + items[1].upper() + "! " + clean, " ".join(split[15:] + ["x", "y"] + split[:15]), " ".join(split[:10]), "has a three word item inside", items[2], items[2], "ha " * 9]
    docs = frame(texts).withColumn("hits", F.lit(1)).withColumn("key", F.lit(2)).withColumn("row", F.lit(3))
    got = decontamination.benchmark_hits(docs, bench)
    assert got.columns == [c for c in docs.columns if c != "hits"] + ["hits"]
    r = {x.doc_id: {h.item_id for h in x.hits} for x in got.collect()}
    want = {0: set(), 1: set(), 2: set(), 3: {1}, 4: {0}, 5: set(), 6: {8}, 7: {2}, 8: {2}, 9: {11}}
    assert r == want
    kept = decontamination.flag_contaminated(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {k for k, v in want.items() if not v}
    assert decontamination.flag_contaminated(frame(texts), bench.limit(0)).count() == len(texts)
    assert decontamination.flag_contaminated(frame(texts).limit(0), bench).count() == 0


def test_decontamination_against_brute_force(spark, frame, monkeypatch):
    random.seed(16)
    words = ["v%d" % k for k in range(30)]
    items = [" ".join(random.choices(words, k=random.choice([1, 3, 5, 8, 20, 30]))) for _ in range(25)]
    bench = spark.createDataFrame([(k // 2 if k else None, t) for k, t in enumerate(items)], "item_id long, text string")
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(random.randint(1, 4)):
            w = random.choice(items).split()
            a = random.randrange(len(w))
            parts += w[a : a + random.randint(3, 30)] + random.choices(words, k=random.randint(0, 4))
        texts.append(" ".join(parts))
    texts += texts[:5]
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    for threshold in (0.5, 0.8):
        got = decontamination.benchmark_hits(frame(texts), bench, threshold=threshold).collect()
        for r in got:
            want = [(None if k == 0 else k // 2, c) for k, t in enumerate(items) if (c := brute_coverage(t, texts[r.doc_id])) >= threshold]
            assert sorted(map(str, [(h.item_id, h.coverage) for h in r.hits])) == sorted(map(str, want))


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    for k in range(0, 300, 3):
        x[k + 1] = x[k] + 0.15 * rng.normal(size=24)
    x[400:520] = x[400] + 0.12 * rng.normal(size=(120, 24))  # a group larger than a list
    x[600:640] = x[600]
    rows = [(k, [float(c) for c in v], "n") for k, v in enumerate(x)]
    rows += [(2000, None, "n"), (2001, [0.0] * 24, "n"), (2002, [float("nan")] * 24, "n"), (2003, [1.0, None] * 12, "n"), (2004, [], "n"), (None, [float(c) for c in 2 * x[600]], "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string").repartition(5)
    shares = []
    got = {r.vec_id: r for r in neighbours.near_vectors(df, report=shares.append).collect()}
    u = np.vstack([x, x[600]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found, true = sum(got[k].n_links for k in range(1500)), link[:1500].sum()
    assert shares[-1] >= 0.9 and 0.98 * true <= found <= true
    assert all(got[k].n_links <= link[k].sum() for k in range(1500))
    assert len({got[k].component_id for k in range(400, 520)}) == 1 and got[400].kept and not got[401].kept
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in range(2000, 2005))
    assert got[None].component_id == 600
    assert neighbours.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_link_dense_groups(spark):
    rng = np.random.default_rng(8)
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    mid = 0.92 * axes[0] + np.sqrt(1 - 0.92**2) * axes[1]
    x = np.vstack([c + 0.01 * rng.normal(size=(n, 24)) for c, n in ((axes[0], 40), (mid, 40), (axes[2], 30), (-axes[5], 1))])
    x = np.vstack([x, x[:3], 0.91 * axes[2] + np.sqrt(1 - 0.91**2) * axes[3]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert link[:40, 40:80].mean() > 0.5
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(df).collect()}
    home = [0] * 80 + [80] * 30 + [110] + [0] * 3 + [80]
    assert got == {k: (int(link[k].sum()), home[k]) for k in range(len(x))}


def test_near_vectors_reach_the_recall_asked_for(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24))
    x[:60] = x[0] + 0.05 * rng.normal(size=(60, 24))  # a hot group must not hide what the pairs lose
    for k in range(100, 900, 2):
        x[k + 1] = x[k] + 0.25 * rng.normal(size=24)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    old, shares = neighbours.TABLES, []
    neighbours.TABLES = 1  # one table loses many pairs
    try:
        got = {r.vec_id: r.n_links for r in neighbours.near_vectors(df, rounds=1, attempts=1, report=shares.append).collect()}
    finally:
        neighbours.TABLES = old
    assert shares[0] < 0.98 and shares[-1] == 1
    assert got == {k: int(link[k].sum()) for k in range(900)}


def test_stages_on_edges(spark, frame, tmp_path):
    sf = str(tmp_path)
    random.seed(21)
    words = ["z%d" % k for k in range(300)]
    prose = [" ".join(random.choices(words, k=60)) for _ in range(12)]
    item = " ".join(random.choices(words, k=30))
    texts = [None, "", *prose, prose[0], prose[0] + " end", item, None, "", prose[3], "long " * 20_000]
    ids = [0, 1, *range(2, 14), 14, 15, 16, None, None, 5, 18]
    sources = [None, "a"] + ["a", "b"] * 9 + ["b"]
    docs = frame(texts, sources, ids)
    for name in ("key", "row", "hits", "copies", "tie", "_q_grade", "_q_tail", "cls", "target", "component_id"):
        docs = docs.withColumn(name, F.lit(1))
    spark.createDataFrame([(k, 1, 0) for k in range(2, 8)] + [(18, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    key = lambda df: sorted((str(r.doc_id), len(r.text or "-")) for r in df.select("doc_id", "text").collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and set(key(out)) <= set(key(docs))
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert not any(r.doc_id == 18 for r in stages.keep_quality(spark, docs, sf).collect())
    kept = stages.one_of_each_group(spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [0, 1, *range(2, 14), 16, None, None, 18]))
    assert not any(r.text == item for r in stages.without_benchmark(spark, docs, sf).collect()) and stages.without_benchmark(spark, docs, sf).count() == len(texts) - 1
    mixed = stages.mix_sources(spark, docs, sf)
    assert key(mixed) == key(stages.mix_sources(spark, docs.repartition(3), sf)) and max(key(mixed).count(k) for k in set(key(mixed)) if k[0] not in ("None", "5")) <= 2
    tokens = stages.to_token_files(spark, docs, sf).collect()
    assert len(tokens) == len(texts) and stages.to_token_files(spark, docs.limit(0), sf).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "test").cut(stage(spark, docs, DATA), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == sizes[-1]
    total = last.agg(F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end")).first()
    assert total.n == total.end
