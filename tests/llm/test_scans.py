"""Operators on single documents: token files, licenses, personal data, secrets, mixing."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import licenses, mixing, pii, secrets, token_files
from paperloom.llm.common import Scratch

ODD = [None, "", " ", "a", "a\n\nb", "tab\there", "x" * 3000, "two  spaces", "end ", "é à", "<|endoftext|> is text", "same", "same", "mix 1 2 3 Ünï 中文 🙂 don't"]


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return P.path("byte_bpe_50k.json"), t


def test_coding_round_trip():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 3, 4, 5, 0, 1000, 7])
    values = (rng.integers(0, 1 << 32, int(counts.sum())) >> rng.integers(0, 32, int(counts.sum()))).astype(np.uint32)
    control, c_off, data, d_off = token_files.pack(values, counts)
    assert (token_files.unpack(control, c_off, data, counts) == values).all()
    assert d_off[-1] == len(data) and len(control) == c_off[-1]


def test_encoder_equals_library(tokenizer):
    path, t = tokenizer
    enc = token_files.Encoder(path)
    random.seed(5)
    parts = ["a", "b'", "'s", " ", "  ", "\n", "\t", "é", "1", "²", "!", " ", " ", "٣", "\r", ".", ",x", "ß."]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(1500)]
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        ids, counts = enc.encode([x.encode() for x in some])
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_pieces_of_equal_code_are_told_apart(tokenizer, monkeypatch):
    path, t = tokenizer
    monkeypatch.setattr(token_files, "_CODES", np.ones_like(token_files._CODES))  # a piece's code is its length
    enc = token_files.Encoder(path)
    for some in (["ab cd ef"], ["ab ab ab"], ["xy xy xy", "ab"], ["ab ab"]):
        ids, counts = enc.encode([x.encode() for x in some])
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_cache_of_pieces_is_bounded(tokenizer, monkeypatch):
    path, t = tokenizer
    monkeypatch.setattr(token_files, "CACHE_BYTES", 200_000)
    enc = token_files.Encoder(path)
    random.seed(8)
    for _ in range(30):
        text = " ".join("%x" % random.randrange(1 << 40) for _ in range(1000))
        ids, _ = enc.encode([text.encode()])
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
        assert enc.known.bytes() < 500_000


def test_token_files(spark, frame, tokenizer):
    path, t = tokenizer
    docs = frame(ODD, ids=[5, 3, 9, 1, 0, 2, 4, 6, 7, 8, 10, 11, 11, None])
    at = Scratch(spark, "test").path("tokens")
    token_files.write_tokens(docs, at, path)
    rows = token_files.read_digests(spark, at).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    texts = dict(zip([5, 3, 9, 1, 0, 2, 4, 6, 7, 8, 10, 11, 11, None], ODD, strict=True))
    start = 0
    for r in rows:
        ids = np.array(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(ODD)
    whole = token_files.read_tokens(spark, at).filter("doc_id = 0").first()
    assert np.frombuffer(bytes(whole.ids), "<u4").tolist() == t.encode("a\n\nb", add_special_tokens=False).ids + [0]


def test_token_files_of_nothing(spark, frame, tokenizer):
    at = Scratch(spark, "test").path("tokens")
    token_files.write_tokens(frame(["x"]).limit(0), at, tokenizer[0])
    assert token_files.read_digests(spark, at).count() == 0


def test_licenses(spark, frame):
    texts = [None, "", "GNU General-Public  LICENSE twice: gnu general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files.", "mit\nlicense", "the cc bypass", "Ünmit license mit licenses", "w " * 5000 + "Apache License", "same mit license", "same mit license"]
    r = licenses.scan_licenses(frame(texts)).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in r[:3]] == [(0, 0, None, None, ""), (0, 0, None, None, ""), (9, 2, 0, 5, "gpl")]
    assert r[3].labels == "mit" and r[3].n_base == 0 and 0.8 <= r[3].score < 1
    assert (r[4].n_base, r[5].n_base, r[6].n_base) == (1, 0, 0)
    assert (r[7].first_word, r[7].base_labels) == (5000, "apache")
    assert r[8].labels == r[9].labels == "mit"
    assert licenses.scan_licenses(frame(texts).limit(0)).count() == 0


def test_licenses_over_lines(spark, frame):
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal"]
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    isc = "# Permission to use, copy, modify, and/or distribute this software for\n# any purpose with or without fee is hereby granted, provided"
    cc0 = "The person has waived all copyright and\nrelated or neighboring rights\n\nto this work"
    words = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()
    scattered = " ".join(w + " x" * 60 for w in words)
    texts = ["\n".join(mit), bsd, isc, cc0, scattered, *("pad " * n + "\r\n".join(mit) + " pad" * 50 for n in (1, 20, 27, 28, 29, 33, 55, 56, 57, 700)), " ".join(words[:15]), " ".join(words[:14])]
    r = licenses.scan_licenses(frame(texts)).orderBy("doc_id").collect()
    assert [x.labels for x in r] == ["mit", "bsd", "isc", "cc0", ""] + ["mit"] * 10 + ["", ""]
    assert all(x.score == 1 for x in r[:4] + r[5:15]) and r[4].score == 0


def test_licenses_are_told_apart(spark, frame):
    want = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "You may copy it under the terms of the GNU General Public License": "gpl",
        "Licensed under the GNU Affero General Public License": "agpl",
        "under the terms of the GNU Lesser General Public License": "lgpl",
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",  # cc-by by the phrase
        "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
        "Released under the Apache License": "apache",
        "Licensed under the Example License, Version 2.0": "",
    }
    r = licenses.scan_licenses(frame(list(want))).orderBy("doc_id").collect()
    assert [x.labels for x in r] == list(want.values())


_E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_C = re.compile(r"[0-9]([\x20-]?[0-9])+")
_P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_entities(t):
    out = [(m.start(), 0, m.end()) for m in _E.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in _I.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in _C.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _P.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_entities_against_plain_patterns():
    random.seed(3)
    parts = ["a", "@", ".", "-", "1", "12", "255", "256", " ", "+", "(", ")", "_", "%", "é", "x.y", "4111111111111111", "a@b.c", "1.2.3.4", "0"]
    for _ in range(4000):
        t = "".join(random.choices(parts, k=random.randint(0, 16)))
        assert brute_entities(t) == pii.base_entities(t)
    assert len(pii.base_entities("9" * 200_000 + " a@b.co")) == 1


def test_contexts_find_new_identifiers(spark, frame):
    known = [f"please contact: user{k}@mail.example.com now" for k in range(12)]
    r = pii.find_personal_data(frame([*known, "please contact: agent-77x today", "version 2.0 here", None, "", "Ünï contact: b2b-9"])).orderBy("doc_id").collect()
    assert [(s.k, s.s, s.e) for s in r[12].spans] == [(4, 16, 25)]
    assert not r[13].spans and not r[14].spans and not r[15].spans
    assert all(len(x.base) == 1 for x in r[:12]) and all(b in x.spans for x in r for b in x.base)
    assert pii.find_personal_data(frame(known).limit(0)).count() == 0


def brute_contexts(texts, rounds=3, confidence=0.7, support=3):
    """Spans by context as defined: per pair of context and instance, without any limits."""
    seen = []
    for d, t in enumerate(texts):
        base = brute_entities(t or "")
        taken = [(s, e) for s, _, e in base]
        found = [(s, e, True) for s, e in taken]
        for m in re.finditer(r"\S*[0-9@]\S*", t or ""):
            raw = m[0].strip(pii._WRAP)
            s = m.start() + len(m[0]) - len(m[0].lstrip(pii._WRAP))
            if raw and re.search("[0-9@]", raw) and not any(a < m.end() and b > m.start() for a, b in taken):
                found.append((s, s + len(raw), False))
        for s, e, seed in found:
            m = re.search(r"(\S+)?\s+(\S+)\s*\Z", " " + t[:s])
            if m:
                context = m[2].lower() if m[2][-1] in ":=#" else f"{m[1]} {m[2]}".lower() if m[1] else None
                if context:
                    seen.append((d, s, e, context, t[s:e].lower(), seed))
    edges = {}
    for *_, c, i, seed in seen:
        n, known = edges.get((c, i), (0, False))
        edges[c, i] = n + 1, known or seed
    conf = {e: float(seed) for e, (_, seed) in edges.items()}
    for _ in range(rounds):
        accepted = {}
        for c in {c for c, _ in edges}:
            own = [e for e in edges if e[0] == c]
            share = sum(edges[e][0] * conf[e] for e in own) / (sum(edges[e][0] for e in own) + 1)
            if share >= confidence and sum(conf[e] >= confidence for e in own) >= support:
                accepted[c] = share
        rest = {i: 1.0 for _, i in edges}
        for c, i in edges:
            rest[i] *= 1 - accepted.get(c, 0.0)
        conf = {(c, i): 1.0 if edges[c, i][1] else 1 - rest[i] for c, i in edges}
    return {(d, s, e) for d, s, e, c, _, seed in seen if not seed and c in accepted}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contexts_against_brute_force(spark, frame, seed):
    random.seed(seed)
    ids = [f"ref{k}x" for k in range(40)] + [f"u{k}@mail.example.com" for k in range(12)] + ["10.0.0.%d" % k for k in range(8)]
    lead = ["contact:", "write to", "the id", "host =", "see page", "a" * 300 + " " + "b" * 250 + ":", "call"]
    texts = [None, ""]
    for _ in range(90):
        parts = []
        for _ in range(random.randint(1, 4)):
            c = random.choice(lead)
            pool = ids[40:52] if c in ("contact:", "write to") and random.random() < 0.85 else ids[52:] if c == "host =" and random.random() < 0.9 else ids
            parts.append(f"{c} {random.choice(pool)}")
        texts.append("so it is. " + " and then ".join(parts) + " end")
    texts += [texts[5]] * 3
    got = pii.find_personal_data(frame(texts)).collect()
    assert {(r.doc_id, s.s, s.e) for r in got for s in r.spans if s.k == 4} == brute_contexts(texts)
    assert any(s.k == 4 for r in got for s in r.spans)


def test_long_words_are_contexts_whole():
    run = "please see " + ",".join("u%d@mail.example.com" % k for k in range(500))
    found = pii.occurrences(run, pii.base_entities(run))
    assert len(found) == 500 and len({x[2] for x in found}) == 500 and max(len(x[2]) for x in found) < 250
    a, b = "q" * 400 + "A:", "q" * 400 + "B:"
    one, two, three = (pii.occurrences(f"x {w} a@b.co", pii.base_entities(f"x {w} a@b.co"))[0][2] for w in (a, b, a))
    assert one == three != two


def test_secrets(spark, frame):
    key = "AKIA" + "ABCDEFGH23456789"
    texts = [None, "", f"é🙂 Api_Key = '{key}'", "deadbeef" * 5, "token: short", "password=abcdef", "id Zx9Kp2LmQ7RtVw4Ys8Ub1NcE end", "averyveryverylongwordwithoutanydigits", "550e8400-e29b-41d4-a716-446655440000", "sampleZx9Kp2LmQ7RtVw4Ys8Ub1NcE", "x" * 50_000]
    r = secrets.scan_secrets(frame(texts)).select("doc_id", secrets.joined("base").alias("base"), secrets.joined("spans").alias("spans")).orderBy("doc_id").collect()
    assert r[0].spans == r[1].spans == r[4].spans == r[7].spans == r[8].spans == r[9].spans == r[10].spans == ""
    assert r[2].base == "assign:3:34,access:14:34"
    assert r[3].base == "hex:0:40" and "entropy" not in r[3].spans  # few different characters
    assert r[5].base == "assign:0:15"
    assert r[6].base == "" and r[6].spans == "entropy:3:27"


def test_every_class_is_scored(spark, frame):
    secret = ["qzjxkvbwphygmfducrlotnseia", "QZJXKVBWPHYGMFDUCRLOTNSEIAQWMZPL", "8361052947813952076428", "QzjXkvBwpHygMfdUcrLotNse==", "QzjXkvBwpHygMfdUcrLotNse", "qzjx-kvbw-phyg-mfdu-crlo-tnse"]
    plain = ["100000000100000000200", "2023-01-01-2023-01-02-2023-01-03", "Donaudampfschifffahrtsgesellschaft", "internationalizationinternational", "CONTRIBUTIONINSTITUTIONS", "content-types-and-text-content"]
    r = secrets.scan_secrets(frame([f"id {s} end" for s in secret + plain])).select("doc_id", secrets.joined("spans").alias("spans")).orderBy("doc_id").collect()
    assert [x.spans for x in r] == [f"entropy:3:{3 + len(s)}" for s in secret] + [""] * len(plain)


def test_window_entropy(spark):
    import math
    from collections import Counter

    s = "aaaaaaaaaaaaaaaaaaaaab3Xz9Q+/=-_bcdefghijklmnopqrst" * 2
    h = lambda w: -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
    got = spark.createDataFrame([(s,)], "s string").select(secrets.max_entropy(F.col("s")).alias("h")).first().h
    assert got == pytest.approx(max(h(s[i : i + 20]) for i in range(len(s) - 19)))


def test_mixing(spark, frame):
    random.seed(2)
    texts = ["w " * random.randint(0, 60) for _ in range(900)] + [None, ""]
    sources = ["hot" if k % 3 else f"s{k % 7}" for k in range(900)] + [None, "empty"]
    m = mixing.systematic_mix(frame(texts, sources), mixing.word_count(F.col("text"))).collect()
    total = sum(r.mix_size for r in m)
    by = {}
    for r in m:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.mix_copies <= 2
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    cap = {s: 2 * by[s][0].mix_source_size for s in by}
    want, left, open_ = {}, 1.5 * total, set(by)
    while True:  # reshare until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = cap[s]
            left -= cap[s]
        open_ -= over
    for s, rows in by.items():
        assert rows[0].mix_target == pytest.approx(want[s])
        assert abs(sum(r.mix_copies * r.mix_size for r in rows) - want[s]) <= 60 * 8
    again = mixing.systematic_mix(frame(texts, sources), mixing.word_count(F.col("text"))).collect()
    assert sorted((r.doc_id, r.mix_copies) for r in m) == sorted((r.doc_id, r.mix_copies) for r in again)
    docs = mixing.mixed_documents(frame(texts, sources))
    assert docs.columns == frame(["x"]).columns and docs.count() == sum(r.mix_copies for r in m)
    assert mixing.systematic_mix(frame(["x"]).limit(0), F.lit(1)).count() == 0
    assert mixing.mixed_documents(frame(["x"]).limit(0)).count() == 0


def test_mixing_with_clashing_columns_and_repeated_rows(spark, frame):
    texts = ["a b c"] * 40 + ["d e"] * 3 + ["long " * 30_000, None, ""]
    ids = [None] * 20 + [5] * 20 + list(range(6))
    docs = frame(texts, ["a", "b"] * 23, ids)
    for name in ("target", "source_size", "_size", "size", "rate", "_rank", "copies", "row", "key", "tie", "src", "none", "class", "slot", "u", "n"):
        docs = docs.withColumn(name, F.lit(7))
    m = mixing.systematic_mix(docs, mixing.word_count(F.col("text")))
    assert m.columns == [*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    rows = m.collect()
    assert len(rows) == 46 and all(r.target == r._size == r.rate == r.key == 7 for r in rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count = lambda df: sorted((str(r.doc_id), r.source, len(r.text or ""), r["count"]) for r in df.groupBy("doc_id", "source", "text").count().collect())
    got = count(out)
    assert got == count(mixing.mixed_documents(docs.repartition(7)))
    assert sum(x[-1] for x in got) == sum(r.mix_copies for r in mixing.systematic_mix(docs, mixing.word_count(F.col("text")), tie=mixing.digest(docs)).collect())
    assert [c for c in mixing.systematic_mix(docs, F.lit(1), prefix="").columns if c in ("size", "target")] == ["size", "target"]


def test_mixing_does_not_depend_on_other_sources(spark, frame):
    random.seed(7)
    texts = ["w " * random.randint(1, 60) for _ in range(300)]
    alone = {r.doc_id: r.mix_copies for r in mixing.systematic_mix(frame(texts, ["a"] * 300), mixing.word_count(F.col("text")), share=0.5).collect()}
    both = mixing.systematic_mix(frame(texts + texts, ["a"] * 300 + ["b"] * 300), mixing.word_count(F.col("text")), weights=(1,), share=0.5).collect()
    assert alone == {r.doc_id: r.mix_copies for r in both if r.source == "a"}


def test_licenses_that_only_begin_alike(spark, frame):
    texts = ["gnu general assembly met", "see cc bylaws", "x apache licenses y", "mit licensed", "MIT License mit licensed", "\u212anown cc by", "MIT L\u0130CENSE", "released under the m\u0130t license"]
    r = licenses.scan_licenses(frame(texts)).orderBy("doc_id").collect()
    assert [(x.n_base, x.first_word, x.last_word) for x in r] == [(0, None, None)] * 4 + [(1, 0, 0), (1, 1, 1), (0, None, None), (0, None, None)]
    assert r[7].labels == ""


def test_licenses_order_words_by_all_texts(spark, frame, monkeypatch):
    texts = [None, "", "AA aa", "x-aa.bb", "x-aa.bb", "aa bb cc", "aa bb cc dd", "aaK bbİ aab"]
    assert licenses.texts_holding(frame(texts), F.col("text"), ["aa", "bb", "cc", "dd", "ee"]) == {"aa": 5, "bb": 4, "cc": 2, "dd": 1}
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    r = licenses.scan_licenses(frame(texts), templates=[("all", "aa bb cc dd")], telling=("aa", "bb", "cc", "dd")).orderBy("doc_id").collect()
    assert [x.labels for x in r] == ["", "", "", "", "", "", "all", ""]
    assert list(sent[0].first().telling) == [3, 2, 1, 0]  # the places of aa, bb, cc, dd, rarest first


def test_licenses_are_the_same_under_any_order(spark, frame, monkeypatch):
    rng = random.Random(3)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    texts = []
    for _, t in licenses.TEMPLATES * 8:
        run = [w for w in t.split() if rng.random() < 0.93]
        for _ in range(rng.randint(0, 4)):
            run.insert(rng.randint(0, len(run)), rng.choice([*words, "other"]))
        texts.append(" ".join([*rng.choices([*words, "other"], k=rng.randint(0, 60)), *run, *rng.choices(words, k=rng.randint(0, 60))]))

    def brute(text):
        ws, labels, best = text.split(), set(), 0
        for label, t in licenses.TEMPLATES:
            own, n = set(t.split()), licenses.run_length(t)
            held = [set(ws[i : i + n]) & own for i in range(len(ws))]
            most = max((len(h) for h in held if own & set(licenses.TELLING) <= h), default=0)
            if most >= 0.8 * len(own):
                labels.add(label)
                best = max(best, most / len(own))
        for p, label in licenses.PHRASES:
            if f" {p} " in f" {text} ":
                labels.add(label)
                best = 1
        return ",".join(sorted(labels)), best

    want = [brute(t) for t in texts]
    assert len({w for w, _ in want}) > 12
    for order in (words, words[::-1], rng.sample(words, len(words))):
        monkeypatch.setattr(licenses, "texts_holding", lambda *_, o=order: {w: n for n, w in enumerate(o)})
        r = licenses.scan_licenses(frame(texts)).orderBy("doc_id").collect()
        assert [(x.labels, x.score) for x in r] == want
