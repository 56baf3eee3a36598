"""The DataFrame operators against brute force, and their edge cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import bpe, embeddings, licenses, packing, pii, quality, recompress, simhash, suffixes, urls
from weftline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, pos long, sig int"
PASSAGE = "".join(f"word{i * i % 97} stands{i % 13} here " for i in range(40))
WORDS = " ".join(f"w{i * i % 101}" for i in range(40))
ROWS = [
    (1, "alpha " * 3 + PASSAGE + "omega", "en"), (2, "other start " + PASSAGE, "en"), (3, None, None), (4, "", "xx"), (5, WORDS, "fr"), (6, "y " + WORDS + " z", None),
    (7, "the the the " * 60, "en"), (8, "the the the " * 50, "en"), (None, "no key " + PASSAGE[:150], "de"), (9, "same text of a repeated row", "en"), (9, "same text of a repeated row", "en"),
    (10, "é" * 400, "fr"), (11, "x" * 30_000, "en"), (12, "\n \t ", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(a, t, g, "s", None, "k", 1, 2, 3) for a, t, g in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text):
    return (text or "").encode()


def covered(tokens, width, count):
    out = np.zeros(len(tokens), bool)
    for i in range(len(tokens) - width + 1):
        if count[tuple(tokens[i : i + width])] > 1:
            out[i : i + width] = True
    return out


def windows(all_tokens, width):
    return Counter(tuple(t[i : i + width]) for t in all_tokens for i in range(len(t) - width + 1))


def check_suffixes(docs):
    rows = [(r.doc_id, raw(r.text)) for r in docs.select("doc_id", "text").collect()]
    count = windows([t for _, t in rows], suffixes.WIDTH)
    want = []
    for k, t in rows:
        c = covered(t, suffixes.WIDTH, count)
        kept = bytes(b for b, x in zip(t, c) if not x)
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        want.append((k, len(t), int(c.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id, r.c.n_bytes, r.c.n_removed, r.c.n_spans, r.c.kept_sha256) for r in suffixes.dedup(docs).select("row.doc_id", F.col("cut").alias("c")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return sum(w[2] for w in want)


def test_suffixes(docs):
    assert check_suffixes(docs) > 0


def test_suffixes_hot_buckets(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 1)
    assert check_suffixes(docs) > 0


@pytest.fixture(scope="module")
def structured(spark):
    """Texts on which weak hashes and minimisers go astray."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(3000))
    words = " ".join("xy"[bin(i).count("1") % 2] for i in range(300))
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    texts = [morse, "b" + morse[700:1500], morse[:300] + "c" + morse[301:600], "a" * 1500, "b" * 199 + "a" * 300, "abcd" * 200, "x" + "abcd" * 120 + "y", fib[-1], fib[-1][5:400], "b" * 198,
             words, "z " + words[40:200], words.replace("x y", "x  y")[:180], "q " * 120, "q " * 40 + "r", "u v w " * 40, "v w u " * 30]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("bucket", [4096, 2])
def test_suffixes_structured(structured, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    assert check_suffixes(structured) > 0


def test_recompress_structured(structured):
    check_words(structured)


def test_recompress(docs):
    check_words(docs)


def check_words(docs):
    rows = [(r.doc_id, raw(r.text).split()) for r in docs.select("doc_id", "text").collect()]
    count = windows([t for _, t in rows], recompress.WIDTH)
    want = []
    for k, t in rows:
        c = covered(t, recompress.WIDTH, count)
        kept = b" ".join(w for w, x in zip(t, c) if not x)
        want.append((k, len(t), int(c.sum()), hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id, r.c.n_words, r.c.n_removed, r.c.kept_sha256) for r in recompress.dedup(docs).select("row.doc_id", F.col("cut").alias("c")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 0


def components_of(fp, ids):
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i, k in enumerate(ids):
        low[find(i)].append(k)
    return [min((k for k in low[find(i)] if k is not None), default=None) for i in range(len(fp))]


@pytest.mark.parametrize("tile", [4096, 2])
def test_simhash(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "GROUP_ROWS", tile)
    r = np.random.default_rng(1)
    base = [" ".join(f"t{x}" for x in r.integers(0, 50, 120)) for _ in range(12)]
    texts = [*base, *[b + f" e{i}" for i, b in enumerate(base)], *[b.replace("t1 ", "T1 ") for b in base], None, "", "one two"]
    df = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in simhash.near_duplicates(df).collect()}
    fp = simhash.fingerprint_arrays([raw(t) for t in texts])
    want = components_of(fp, [i * 3 + 1 for i in range(len(texts))])
    assert [got[i * 3 + 1].component_id for i in range(len(texts))] == want
    assert [int(got[i * 3 + 1].fingerprint, 16) for i in range(len(texts))] == fp.tolist()


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 8))
    x = np.concatenate([x, x[:30] + r.normal(size=(30, 8)) * 0.08, x[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, x[0].tolist(), None), (204, [1.0, None] + [0.0] * 6, 0), (205, [1.0], 0), (206, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {g.vec_id: g for g in embeddings.near_duplicates(df).collect()}
    v = x.astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.arange(len(x)) % 2
    link = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min(root[j] for j in np.flatnonzero(link[i])) for i in range(len(x))]
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum() - 1, root[i], root[i] == i)
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k, *_ in odd)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_packing(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, capacity=64).collect()
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(r.length for r in got if r.doc_id == 3) == 1 and sum(r.length for r in got) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens * len([x for x in got if x.doc_id == r.doc_id and x.start == 0]) for r in got}.values())
    assert packing.pack_documents(none, path).count() == 0


def test_round_trips(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trips(docs, path).collect()), key=repr) == sorted(want, key=repr)
    full = bpe.encode_documents(docs, path).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in full) == sorted((w[0] or 0, w[1]) for w in want)
    assert bpe.round_trips(none, path).count() == 0


def test_quality(docs, none):
    got = quality.verdicts(docs).collect()
    assert len(got) == len(ROWS) and all(not r.kept for r in got if r.base_failed)
    assert quality.keep_good(docs).count() == sum(r.kept for r in got)
    assert quality.verdicts(none).count() == 0


def test_quality_reference_per_language(spark):
    import random

    r = random.Random(4)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(150)) + "."
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя"
    rows = [(i, text(latin), "it") for i in range(90)] + [(100 + i, text(cyrillic), "ru") for i in range(10)]
    rows += [(200, " ".join("#$% 1 2 & 77 |" for _ in range(1)) + " " + " ".join(f"{i * i}#" for i in range(150)), "ru"), (201, text("0123456789#$"), "it")]
    got = {x.doc_id: x.kept for x in quality.verdicts(spark.createDataFrame(rows, SCHEMA.split(",")[0] + ", text string, lang string")).collect()}
    assert got == {i: i < 200 for i, _, _ in rows}


def test_pii(spark, docs, none):
    df = spark.createDataFrame([(1, 'a@b.co x token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" y', "k")], "doc_id long, text string, key string")
    row = pii.spans(df).first()
    assert row.n_email == 1 and row.spans == "email:0:6,secret:18:58"
    assert pii.redact(df).first().text == '[EMAIL] x token = "[SECRET]" y'
    assert pii.spans(docs).count() == len(ROWS) and pii.spans(none).count() == 0
    assert pii.redact(docs).filter("text is null").count() == 1


def test_pii_long_tokens_and_upper_case_addresses(spark):
    token = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(3))
    rows = [(1, f'token = "{token}" y'), (2, "device DE:AD:BE:EF:CA:FE up"), (3, "word " + "a" * 300)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 'token = "[SECRET]" y', 2: "device [HARDWARE] up", 3: rows[2][1]}


def test_urls(spark):
    rows = [(1, "http://U:p@Spam-Farm.example.org:80/x", "2024-02-01"), (2, "https://a.spam-farm.example.org.", "2024-06-15"), (3, None, "2024-03-01"), (4, "no url", "2024-03-01"),
            (5, "https://x.cheap-pills.example.com", "2024-03-15"), (6, "https://notspam-farm.example.org", "2024-02-02"), (7, "https://spam-farm.example.org", None), (1, "http://U:p@Spam-Farm.example.org:80/x", "2024-02-01")]
    df = spark.createDataFrame(rows, "id long, url string, day string").withColumn("at", F.col("day").cast("date")).withColumn("domain", F.lit("clash"))
    got = sorted(((r.id, r.listed, r.matched_domain, r.category) for r in urls.filter_urls(df, urls.entries(spark), "id", "url", "at").collect()), key=repr)
    assert got == sorted([(1, True, "spam-farm.example.org", "spam")] * 2 + [(i, False, None, None) for i in (2, 3, 4, 6, 7)] + [(5, True, "cheap-pills.example.com", "pharmacy")], key=repr)


def test_licenses(spark, none):
    text = "prose here\nReleased under the MIT License.\nhis driving license was suspended"
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (2, "Licensed under CC BY-NC 4.0", 0), (2, "Licensed under CC BY-NC 4.0", 0)], "doc_id long, text string, body int")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(df).collect())
    assert got == [(1, 1, "mit"), (2, 0, "cc-by-nc-4.0"), (2, 0, "cc-by-nc-4.0")]
    assert licenses.scan(none).count() == 0


def test_licenses_wrapped_and_outside_templates(spark):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"
    gpl = "This program is free software: you can redistribute it\nand/or modify it under the terms of the\nGNU General Public License"
    epl = "This work is licensed under the Eclipse Public License, version 2.0"
    prose = "it was the best of times and they may not have any use for it by the river or at an inn which is under the hill, with a copy of the book that you can read as you like\n" * 6
    rows = [(1, f"start\n \n{mit}\n\nend\n"), (2, f"\n{bsd}\n\n{gpl}"), (3, epl), (3, epl), (4, prose), (5, f"x\n\nReleased under the MIT License.\nmore\n\n{mit}")]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, "mit"), (2, 1, "bsd"), (2, 5, "gpl-3.0"), (3, 0, "unknown-licence"), (3, 0, "unknown-licence"), (5, 2, "mit"), (5, 5, "mit")]


def test_licence_versions_and_broken_notices(spark):
    long = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License"
    rows = [
        "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 3.", long.format(2), long.format(3),
        "Licensed under the GNU Lesser General Public License", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0",
        "Released under the ISC License", "This is free and unencumbered software released into the public domain", "Licensed under CC0 1.0 Universal", "Licensed under the GNU Affero General Public License, version 3",
        "This work is licensed under the GNU General Public", "Released under the MIT", "Redistribution and use in source and binary forms, with or without",
    ]
    want = ["gpl-2.0", "gpl-3.0", "gpl-2.0", "gpl-3.0", "lgpl", "mpl-2.0", "cc-by-4.0", "cc-by-sa-4.0", "isc", "unlicense", "cc0-1.0", "agpl-3.0"] + ["unknown-licence"] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert [r.family for r in licenses.scan(df).orderBy("doc_id").collect()] == want


def literal_scan(text):
    """(paragraph, families) of the lines of a text, line by line, by the model and templates as they stand."""
    weights, bias = licenses.model()
    out = []
    for i, line in enumerate(text.split("\n")):
        ws = licenses.words_of(line)
        own = set(licenses.grams(ws, 1)) | set(licenses.grams(ws, 2))
        z = np.array(bias) + sum((np.array(weights[g]) for g in own if g in weights), np.zeros(len(bias)))
        p = np.exp(z - z.max())
        p /= p.sum()
        tri, held = set(licenses.grams(ws, 3)), []
        for f, ts in licenses.TEMPLATES.items():
            for t in ts:
                need = {n for n in licenses.NEEDS.get(f, []) if n in licenses.windows(t)}
                c, n = len(tri & licenses.windows(t)), len(licenses.windows(t))
                if need <= tri and c:
                    held.append((c >= licenses.CONFIRM * n, c, f))
        firm, _, name = max(held, default=(False, 0, None))
        best = licenses.FAMILIES[int(p.argmax())]
        if firm and p.max() >= licenses.LIMIT and best == name:
            out.append((i, best))
        elif firm or p[-1] <= 1 - licenses.LIMIT:
            out.append((i, "unknown-licence"))
    return out


def test_licenses_against_line_by_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    # lines set apart by blank ones are blocks of their own
    apart = docs.withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    want = sorted((r.doc_id, i, f) for r in apart.collect() for i, f in literal_scan(r.text or ""))
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(apart).collect())
    assert got == want and len(want) > 20


def test_repeated_rows_are_linear(spark):
    body = PASSAGE * 2
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, body).otherwise(body + " tail").alias("text"))
    out = suffixes.dedup(df).select("cut.n_bytes", "cut.n_removed").groupBy("n_bytes").agg(F.count("*").alias("n"), F.min("n_removed").alias("gone"))
    assert {(r.n_bytes, r.n, r.gone) for r in out.collect()} == {(len(body), 10_000, len(body)), (len(body) + 5, 10_000, len(body) + 5)}
    assert recompress.dedup(df).filter("cut.n_removed < cut.n_words").count() == 0


def test_clashing_columns(spark):
    names = ["_k", "_z", "_marks", "_null", "_cut", "_h", "row", "cut", "h", "n", "own", "mine", "key", "body"]
    df = spark.createDataFrame([(i, PASSAGE + f" {i}", "en", *range(len(names))) for i in range(3)], ["doc_id", "text", "lang", *names])
    for out in (suffixes.dedup_texts(df), simhash.keep_one(df), quality.keep_good(df), pii.redact(df)):
        assert out.columns == df.columns and all([r[n] for n in names] == list(range(len(names))) for r in out.collect())
    assert recompress.dedup(df).select("row.*").columns == [c for c in df.columns if c != "text"]
    assert packing.pack_documents(df, __import__("public_tokenizers").path("byte_bpe_50k.json")).count() == 3
    assert simhash.near_duplicates(df).count() == 3 and bpe.round_trips(df, __import__("public_tokenizers").path("word_bpe_49k.json")).count() == 3


def test_keep_one_by_row(spark):
    t, u = "one two three four " * 5, "red green blue black " * 5
    keep = lambda rows: sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert keep([(1, t), (None, t), (None, u)]) == sorted([(1, t), (None, u)], key=repr)
    assert keep([(1, t), (9, t), (9, u)]) == [(1, t), (9, u)]
    assert keep([(5, t), (5, t), (None, t)]) == [(5, t)] and keep([(None, u), (None, u)]) == [(None, u)]


def test_packing_against_the_library(spark, docs):
    import struct
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 64):
            part = ids[a : a + 64]
            want[(r.doc_id, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids))] += 1
    got = packing.pack_documents(docs, path, capacity=64)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.collect()) == want
    # full pieces are sequences of their own, rests of one size fill their group's bins
    ties = spark.createDataFrame([(i, "a") for i in range(40)], "doc_id long, text string")
    size = {r.length for r in packing.pack_documents(ties, path, capacity=64).collect()}
    assert len(size) == 1 and packing.pack_documents(ties, path, capacity=64).select("sequence_id").distinct().count() == -(-40 // (64 // size.pop()))


def literal_base(text):
    """The four base kinds by the plain patterns, one after the other."""
    import re

    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 14 <= len(digits) <= 19 and odd % 10 == 0:
            found.append((m.start(), 2, m.end(), "card"))
    found += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_pii_against_plain_patterns(spark):
    import random

    r = random.Random(6)
    odd = ["".join(r.choice("0123456789 .-+@ab()%") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = {x.doc_id: x for x in pii.spans(df).collect()}
    for x in df.collect():
        base = literal_base(x.text or "")
        g = got[x.doc_id]
        assert g.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [base.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, base.split(","))) <= set(g.spans.split(","))


def test_pii_trees_against_walks():
    trees, limits = pii.model()
    x, _ = pii.labelled(300, seed=5)
    for row, p in zip(x, trees.score(x)):
        total = trees.start
        for f, c, v in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - 7]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))
    text = "write abcdefghijklmnopqrstuvwxyz0123@ex.org, iban DE89 3704 0044 0532 0130 00"
    base, added = pii.find([text], trees, limits)
    assert [s[2] for s in base[0]] == ["email"] and [s[2] for s in added[0]] == ["account"]


def test_quality_against_arithmetic(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    measured = {r.doc_id: quality.measure(r.text or "", r.lang) for r in rows}
    failed = {k: m[0] < 50 or 100 * m[4] > 50 * m[0] for k, m in measured.items()}

    def entropy(p):
        return -sum(x * np.log2(x) for x in p if x > 0)

    def far(hist, total):
        p, q = np.array(hist) / max(sum(hist), 1), np.array(total) / max(sum(total), 1)
        return max(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2, 0) ** 0.5

    want = {}
    for lang in {r.lang for r in rows}:
        own = [r.doc_id for r in rows if r.lang == lang]
        pool = [k for k in own if not failed[k]]
        for turn in range(2):
            refs = [np.sum([measured[k][s] for k in pool], axis=0) for s in (5, 6)]
            d = {k: [far(measured[k][s], refs[s - 5]) if sum(measured[k][s]) >= g else 0.0 for s, g in ((5, quality.CHAR_GUARD), (6, quality.WORD_GUARD))] for k in own}
            near = [k for k in own if not failed[k] and d[k][0] <= quality.TRIM[0] and d[k][1] <= quality.TRIM[1]]
            pool = near or pool
        for k in own:
            long = measured[k][0] >= quality.LONG
            want[k] = not (failed[k] or d[k][0] > quality.ALONE[long] or d[k][0] > quality.PAIR[long][0] and d[k][1] > quality.PAIR[long][1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert {k: r.kept for k, r in got.items()} == want and {k: r.base_failed for k, r in got.items()} == failed
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {k for k, v in want.items() if v}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    low = [k for k, q in labels.items() if q == 0 and k in want]
    assert sum(not want[k] for k in low) >= 0.9 * len(low)


def test_pipeline_on_odd_tables(spark, docs, none):
    for rows in (none, docs.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        assert rows.columns[0] == "doc_id" and rows.count() >= 0


def test_empty_tables(none):
    assert suffixes.dedup(none).count() == 0 and recompress.dedup(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_extra_columns_and_kept_rows(docs):
    out = suffixes.dedup_texts(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS) and out.filter("text is null").count() == 1
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and one.filter("doc_id = 9").count() == 1


def test_pipeline_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
    by_doc = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert by_doc.filter("n <> t").count() == 0 and 0 < by_doc.count() < documents.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import oracle

    assert oracle.differences(QUERIES[name](spark, SF), ORACLES[name], oracle.views(SF)) == []
