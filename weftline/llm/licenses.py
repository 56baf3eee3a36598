"""License scans: a trained paragraph classifier and template comparison, scored by DataFrame operations only.

Paragraphs are lines, and blocks of lines between blank ones, joined, so that wrapped notices are whole. A multinomial
logistic regression over sparse word n-grams (one and two words, presence) gives each licence family's probability
beside an unknown class, calibrated by a temperature fitted on held-out rows. A paragraph is reported under its best
family if that probability reaches LIMIT and one of the family's templates confirms it: at least CONFIRM of the
template's three-word windows stand in the paragraph, and with them those that tell the family from its kin (NEEDS: the
version, the word "lesser"). Of templates that do, the one with the most windows counts. A paragraph that is a licence's
by the classifier (the unknown class has at most 1 - LIMIT) or by a template, but not one family's by both, is reported
as unknown-licence. A General Public License that states no version is reported as the newest. A block is reported where
it names a family that none of its lines names, in place of those lines' partial hits, or where none of its lines is
reported.

The regression is trained here, on TRAIN_ROWS paragraphs written from the templates with a fixed seed. Its n-grams are
those that hold one of the `gate` words, the templates' words that are not everyday ones. A paragraph without any of
these words has no n-gram of the model, whose bias alone names the unknown class, and under CONFIRM of any template's
windows; it can never be reported, and so it leaves the plan at the scan. Equal paragraphs are scored once and joined back.

Defined results: null text has no paragraphs; ties of probability go to the first family by name; repeated rows are
reported as often as they occur; texts of any length are scanned whole; extra columns stay out of the result, whatever
their names; no rows give no rows.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

TRAIN_ROWS = 4000
LIMIT = 0.5
CONFIRM = 0.8

# How the families' notices read.
TEMPLATES = {
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc0-1.0": [
        "Licensed under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "isc": [
        "Released under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    ],
}
# Three-word windows that must stand in a paragraph, where the family has one of them in the template.
NEEDS = {
    "agpl-3.0": ["gnu affero general"], "cc-by-4.0": ["cc by 4", "attribution 4 0"], "cc-by-nc-4.0": ["by nc 4", "attribution noncommercial 4"],
    "cc-by-sa-4.0": ["by sa 4", "attribution sharealike 4"], "gpl-2.0": ["gnu general public", "license version 2", "version 2 of"],
    "gpl-3.0": ["gnu general public", "license version 3", "version 3 of"], "lgpl": ["gnu lesser general"], "mpl-2.0": ["mozilla public license"],
}
UNKNOWN = "unknown"
FAMILIES = [*sorted(TEMPLATES), UNKNOWN]
# Sentences that speak of licences and software without granting any.
NEGATIVES = [
    "his driving license was suspended for a month", "the license plate was never found", "a license to sell fish is required in this town",
    "free software conference opens in spring", "the general public was admitted free of charge", "version 2.0 of the program was released last week",
    "all rights reserved by the owner of the theatre", "permission to enter was granted by the guard", "the public library lends this work to any person",
    "conditions are met when the source of water is permitted", "the apache people and their history", "creative work in the commons garden",
    "the software was distributed to all schools", "a lesser man would have left", "the foundation was published by the university", "she was released under the terms of the court",
]
# Everyday words of the templates, of which prose is full.
PLAIN = (
    "the of and to a in is that it was for on are with as be by this at from or an have not you he they which any may can under use without all if into will "
    "except following free work copy file files person program public general either both fee purpose v 1 2 3 4 0 basis form forms source code law author at obtain obtained "
    "international related appear above one extent possible sell writing agreed style universal anyone required met has conditions library commons creative rights charge notice"
).split()


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def windows(template: str) -> set[str]:
    return set(grams(words_of(template), 3))


def training(rows: int, seed: int = 3, cut: float = 0.0) -> tuple[list[list[str]], np.ndarray]:
    """Paragraphs as words, and their families' places: templates with noise and lead-ins, a share `cut` of them broken
    off, and other prose."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou" if i % 2 else "bdlmnrst") for i in range(r.randint(2, 8)))
    pool = [w for v in TEMPLATES.values() for t in v for w in words_of(t)]
    out, y = [], []
    while len(out) < rows:
        k = r.randrange(len(FAMILIES)) if r.random() < 0.7 else len(TEMPLATES)
        if FAMILIES[k] == UNKNOWN:
            kind = r.random()
            if kind < 0.25:
                ws = words_of(r.choice(NEGATIVES))
            elif kind < 0.4:
                ws = [r.choice(PLAIN) if r.random() < 0.5 else word() for _ in range(r.randint(30, 400))]
            elif kind < 0.7:
                ws = [r.choice(pool) if r.random() < 0.4 else word() for _ in range(r.randint(3, 25))]
            else:
                ws = [word() for _ in range(r.randint(3, 30))]
        else:
            need = {w for g in NEEDS.get(FAMILIES[k], []) for w in g.split()}
            ws = [w for w in words_of(r.choice(TEMPLATES[FAMILIES[k]])) if w in need or r.random() > 0.05]
            ws = ws[: max(4, int(len(ws) * r.uniform(0.4, 1)))] if r.random() < cut else ws
        lead = [word() for _ in range(r.choice([0, 0, 0, 2, 6]))]
        out.append([*lead, *ws, *[word() for _ in range(r.choice([0, 0, 0, 3, 8]))]])
        y.append(k)
    return out, np.array(y)


def gate() -> list[str]:
    """The templates' words that are not everyday ones."""
    return sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)} - set(PLAIN))


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, list[float]], list[float]]:
    """Weights of the n-grams that hold a gate word, and the biases, over the temperature."""
    texts, y = training(TRAIN_ROWS, cut=0.2)
    key = set(gate())
    feats = [{g for n in (1, 2) for g in grams(t, n) if key & set(g.split())} for t in texts]
    count: dict[str, int] = {}
    for f in feats:
        for g in f:
            count[g] = count.get(g, 0) + 1
    names = sorted(g for g, n in count.items() if n >= 4)
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(texts), len(names)))
    for i, f in enumerate(feats):
        x[i, [at[g] for g in f if g in at]] = 1
    fit = np.arange(len(y)) % 3 > 0
    target = np.eye(len(FAMILIES))[y]

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    w, b = np.zeros((x.shape[1], len(FAMILIES))), np.zeros(len(FAMILIES))
    own, truth = x[fit], target[fit]
    for _ in range(300):
        d = (soft(own @ w + b) - truth) / len(truth)
        w -= 4.0 * (own.T @ d + 1e-4 * w)
        b -= 4.0 * d.sum(0)
    z, t = x[~fit] @ w + b, target[~fit]
    heats = np.linspace(0.3, 3, 28)
    heat = heats[np.argmin([-(t * np.log(soft(z / h) + 1e-12)).sum() for h in heats])]
    w, b = np.round(w / heat, 6), np.round(b / heat, 6)
    if soft(b[None, :])[0, -1] <= 1 - LIMIT:
        raise ValueError("a paragraph without any n-gram of the model would be reported")
    return {names[k]: w[k].tolist() for k in range(len(names))}, b.tolist()


def _pattern(words: list[str]) -> str:
    """One of the words, by their first letters."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items()))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A literal table; it holds the model or the templates, which do not grow with the input."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _grams(words: Column, n: int) -> Column:
    """n-grams of an array of words."""
    last = F.size(words) - n + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of value, which is evaluated once."""
    return F.transform(F.array(value), fn)[0]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per licence paragraph: key, paragraph (its first line, from 0), family, probability and coverage (of the template)."""
    spark = docs.sparkSession
    weights, bias = model()
    k = len(FAMILIES)
    gated = rf"(?<![a-z0-9])(?:{_pattern(gate())})(?![a-z0-9])"
    body = docs[text].cast("string")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike("[A-Za-z0-9]"), F.concat(i.cast("string"), F.lit("\x01"), x)).otherwise(""))
    held = docs.select(docs[key].alias("key"), body.alias("text")).filter(F.lower("text").rlike(gated))
    blocks = held.select("key", F.explode(F.split(F.array_join(lines, "\n"), "\n{2,}")).alias("block")).filter("block <> ''")
    blocks = blocks.select("key", F.monotonically_increasing_id().alias("at"), F.split(F.btrim("block", F.lit("\n")), "\n").alias("lines"))
    units = F.transform("lines", lambda x: F.struct(F.substring_index(x, "\x01", 1).cast("int").alias("paragraph"), F.lit(False).alias("whole"), _normal(F.regexp_replace(x, "^[0-9]+\x01", "")).alias("body")))
    whole = lambda u: F.struct(u[0].paragraph.alias("paragraph"), F.lit(True).alias("whole"), F.array_join(F.filter(u.body, lambda b: b != ""), " ").alias("body"))
    blocks = blocks.select("key", "at", F.explode(_let(units, lambda u: F.when(F.size(u) > 1, F.concat(u, F.array(whole(u)))).otherwise(u))).alias("p"))
    rows = Scratch(spark).put(blocks.select("key", "at", "p.*").filter(F.col("body").rlike(gated)))
    seen = rows.groupBy("body").agg(F.count("*").alias("n")).select("body", F.split("body", " ").alias("w"))
    wide = _table(spark, [{"gram": g, "weight": v} for g, v in weights.items()], "gram: string, weight: array<double>")
    found = seen.select("body", F.explode(F.array_distinct(F.concat(_grams(F.col("w"), 1), _grams(F.col("w"), 2)))).alias("gram")).join(wide, "gram")
    logits = found.groupBy("body").agg(F.array(*[F.sum(F.col("weight")[i]) + F.lit(bias[i]) for i in range(k)]).alias("z"))
    power = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
    share = F.transform(power, lambda v: v / F.aggregate(power, F.lit(0.0), lambda s, e: s + e))
    top = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("p", F.array_max("p")).cast("int"))
    judged = logits.select("body", share.alias("p")).select("body", top.alias("best"), F.array_max("p").alias("high"), F.element_at("p", -1).alias("none"))
    listed = [
        {"gram": g, "family": f, "template": i, "size": len(windows(t)), "need": int(g in NEEDS.get(f, [])), "needs": sum(n in windows(t) for n in NEEDS.get(f, []))}
        for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for g in sorted(windows(t))
    ]
    own = _table(spark, listed, "gram: string, family: string, template: int, size: int, need: int, needs: int")
    met = seen.select("body", F.explode(F.array_distinct(_grams(F.col("w"), 3))).alias("gram")).join(own, "gram")
    cover = met.groupBy("body", "family", "template", "size", "needs").agg(F.count("*").alias("c"), F.sum("need").alias("need")).filter("need = needs")
    share = (F.col("c") / F.col("size")).alias("coverage")
    cover = cover.groupBy("body").agg(F.max(F.struct((F.col("c") >= CONFIRM * F.col("size")).alias("firm"), "c", "family", share)).alias("m")).select("body", "m.coverage", "m.firm", F.col("m.family").alias("held"))
    by = judged.join(cover, "body", "full_outer")
    sure = F.coalesce(F.col("none") <= 1 - LIMIT, F.lit(False))
    held_up = F.coalesce(F.col("firm"), F.lit(False))
    named = held_up & F.coalesce((F.col("high") >= LIMIT) & (F.col("best") == F.col("held")), F.lit(False))
    family = F.when(named, F.col("held")).when(sure | held_up, F.lit("unknown-licence"))
    probability = F.round("high", 4).alias("probability")
    found = by.select("body", family.alias("family"), "best", "held", probability, F.round("coverage", 4).alias("coverage")).filter("family is not null")
    hits = rows.join(found, "body").drop("body")
    # Of a block and its lines: the block where it names a family that none of its lines does, or where no line is reported.
    of = Window.partitionBy("at")
    named = F.max(F.when(F.col("whole") & (F.col("family") != "unknown-licence"), F.col("family"))).over(of)
    said = F.collect_set(F.when(~F.col("whole"), F.col("family"))).over(of)
    judged = hits.withColumns({"named": named, "said": said})
    stands = F.when(F.col("family") == "unknown-licence", F.size("said") == 0).otherwise(~F.array_contains("said", F.col("family")))
    part = (F.col("family") == "unknown-licence") & F.col("named").isNotNull() & ~F.array_contains("said", F.col("named"))
    kept = judged.filter(F.when(F.col("whole"), stands).otherwise(~F.coalesce(part, F.lit(False))))
    return kept.select(F.col("key").alias(key), "paragraph", "family", "probability", "coverage")
