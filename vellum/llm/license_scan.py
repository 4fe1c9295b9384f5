"""License scans: a trained paragraph classifier with a calibrated unknown class and template comparison.

A paragraph is a line, or a block of neighbouring lines that have words (wrapped notices). Blocks are taken apart into
windows of ``WINDOW`` words that overlap by half, so that each copy of a template lies whole in one; a block gives a row
for a family that its best window has and none of its lines alone. A paragraph's features are its words and pairs of neighbouring words (lower case, split at anything but
letters and digits). A multinomial logistic regression over licence families and the class ``unknown`` gives each
paragraph a family and a probability; the probability is calibrated on training rows held out from the fit, and a
prediction stands if it reaches ``MIN_PROBABILITY``. Then the paragraph is compared with the family's templates: the
share of a template's word pairs that it holds must reach ``MIN_TEMPLATE``.

Training is the only part on the driver: at most ``MAX_TEMPLATE_ROWS`` rows made from the templates and names below, and
``MAX_NEGATIVES`` paragraphs of the corpus (those of least hash, a bounded and documented sample) that hold no template.
Scoring uses DataFrame functions only and covers every paragraph of every document.

Scale: a paragraph can only pass the comparison if it has one of the key words, chosen at fit time so that in every
template enough word pairs touch one (``key_words`` checks this). Texts without a key word end at one array test; only
the others' paragraphs are taken apart, and features meet the weights, a table of a row for each word and word pair of the templates.

Defined cases: a null or empty text has no licence; repeated rows each give their rows; a licence line that many
documents share is found in each; with no negatives in the corpus the model rests on the templates alone; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.session import cut_lineage

UNKNOWN = "unknown"
MAX_NEGATIVES = 2000
MAX_TEMPLATE_ROWS = 5000
MIN_PROBABILITY = 0.5
MIN_TEMPLATE = 0.6
EPOCHS, RATE, DECAY = 300, 4.0, 1e-5
FOLDS = 4               # one fold in so many calibrates
SMOOTH = 0.02

# Customary names of licence families and opening words of public licence notices.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL version 3"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Software License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License"],
    "cc0": ["CC0 1.0 Universal", "Creative Commons Zero"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL version 3"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL version 3"],
    "mit": ["MIT License", "Expat License"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "proprietary": ["All rights reserved"],
}
NOTICES = {
    "apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
PHRASES = ["{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.",
           "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.",
           "This content is available under {}.", "See the {} for details."]


def tokens(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def features(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in itertools.pairwise(words))]))


def pairs(words: list[str]) -> set[str]:
    """A template's or paragraph's word pairs; one word stands for itself."""
    return {f"{a} {b}" for a, b in itertools.pairwise(words)} or set(words)


TEMPLATES = [(family, tokens(t)) for source in (NAMES, NOTICES) for family, texts in sorted(source.items()) for t in texts]
WINDOW = 2 * max(len(w) for _, w in TEMPLATES)


def training_rows() -> list[tuple[str, list[str]]]:
    """Labelled rows from names in phrases and from notices, whole and in halves that overlap."""
    rows = [(f, tokens(p.format(n))) for f, names in sorted(NAMES.items()) for n in names for p in PHRASES]
    for family, texts in sorted(NOTICES.items()):
        for w in map(tokens, texts):
            half = len(w) // 2
            rows += [(family, w)] * 3 + [(family, w[:half + 4]), (family, w[half - 4:])]
    return rows[:MAX_TEMPLATE_ROWS]


def key_words(common: set[str]) -> list[str]:
    """Words of which a paragraph must have one to hold ``MIN_TEMPLATE`` of any template's pairs. Words that are
    common in the corpus are taken last."""
    chosen: set[str] = set()
    for _, w in TEMPLATES:
        p = pairs(w)
        uncovered = lambda: sum(not chosen & set(x.split()) for x in p)
        # what is left without a key word must be too little to pass
        for x in sorted(set(w), key=lambda x: (x in common, x.isdigit() or len(x) < 4, -sum(x in t for _, t in TEMPLATES), x)):
            if uncovered() < MIN_TEMPLATE * len(p):
                break
            chosen.add(x)
        assert uncovered() < MIN_TEMPLATE * len(p)
    return sorted(chosen)


@dataclass
class Model:
    families: list[str]              # classes, ``unknown`` last
    weights: dict[str, list[float]]  # by feature, one number for each class
    bias: list[float]
    scale: float                     # calibration: logits are multiplied by it
    keys: list[str]


def _fit(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    onehot = np.eye(classes, dtype=np.float32)[y]
    share = 1.0 / np.bincount(y, minlength=classes).clip(1)[y]  # every class weighs the same
    share = (share / share.sum())[:, None].astype(np.float32)
    for _ in range(EPOCHS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - onehot) * share
        w -= RATE * (x.T @ g + DECAY * w)
        b -= RATE * g.sum(axis=0)
    return w, b


def _scale(z: np.ndarray, y: np.ndarray) -> float:
    """The factor on logits that gives held-out rows the greatest likelihood, a share ``SMOOTH`` of each label being
    dealt to all classes (else rows that are told apart perfectly would ask for an endless factor)."""
    def loss(s: float) -> float:
        v = z.astype(np.float64) * s
        v = v - v.max(axis=1, keepdims=True)
        logp = v - np.log(np.exp(v).sum(axis=1, keepdims=True))
        return float(-((1 - SMOOTH) * logp[np.arange(len(y)), y] + SMOOTH * logp.mean(axis=1)).mean())
    return min((loss(s), s) for s in np.geomspace(0.1, 10, 41))[1] if len(y) else 1.0


def fit(negatives: list[str]) -> Model:
    """The model from the templates and a bounded sample of other paragraphs."""
    rows = training_rows()
    template_pairs = [pairs(w) for _, w in TEMPLATES]
    for text in sorted(negatives):
        w = tokens(text)
        p = pairs(w)
        # nor lines of a wrapped notice
        if w and not any(len(t & p) >= MIN_TEMPLATE * min(len(t), len(p)) for t in template_pairs):
            rows.append((UNKNOWN, w))
    rows.append((UNKNOWN, []))
    families = [*sorted({f for f, _ in rows} - {UNKNOWN}), UNKNOWN]
    y = np.array([families.index(f) for f, _ in rows])
    # features that licences have: others carry no weight for any family, and the bias speaks for ``unknown``
    own = sorted({n for f, w in rows if f != UNKNOWN for n in features(w)})
    vocabulary = {n: k for k, n in enumerate(own)}
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for k, (_, w) in enumerate(rows):
        x[k, [vocabulary[n] for n in features(w) if n in vocabulary]] = 1.0
    held = np.arange(len(rows)) % FOLDS == FOLDS - 1
    w, b = _fit(x[~held], y[~held], len(families))
    scale = _scale(x[held] @ w + b, y[held])
    w, b = _fit(x, y, len(families))
    common = {n for n in (t for f, r in rows if f == UNKNOWN for t in r)}
    weights = {n: [float(v) for v in w[k]] for n, k in vocabulary.items() if np.abs(w[k]).max() > 1e-3}
    return Model(families, weights, [float(v) for v in b], scale, key_words(common))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def sample_negatives(docs: DataFrame, limit: int = MAX_NEGATIVES) -> list[str]:
    """Different paragraphs of least hash, one (of 20 to 1,000 characters) from each of the documents picked by the hash of
    their text, any of its lines by the same hash: a sample of bounded size, equal in every run. Picking some ``4 * limit``
    documents first keeps what tasks send to the driver bounded however many they are."""
    n = docs.count()
    h = F.xxhash64(F.lit("sample"), "text")
    share = F.pmod(h, F.lit(1 << 20)) < int(min(1.0, 4 * limit / max(n, 1)) * (1 << 20)) + 1
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) >= 20) & (F.length(x) <= 1000))
    some = docs.where(F.col("text").isNotNull() & share).select(lines.alias("ls"), F.shiftrightunsigned(h, 20).alias("h"))
    some = some.where(F.size("ls") > 0).select(F.get("ls", F.pmod("h", F.size("ls")).cast("int")).alias("p")).distinct()
    return [r["p"] for r in some.select("p", F.xxhash64("p").alias("h")).orderBy("h", "p").limit(limit).collect()]


def _paragraphs(lines: Column) -> Column:
    """The paragraphs (paragraph, last, w) of a text's ``lines``, each an array of words: every line (``last`` null), and
    the windows of every block of two lines or more, with the block's first and last line."""
    n = lambda i: F.coalesce(F.size(F.get(lines, i)), F.lit(0))
    single = F.transform(lines, lambda w, i: F.struct(i.alias("paragraph"), F.lit(None).cast("int").alias("last"), w.alias("w")))
    edge = lambda step: F.filter(F.transform(lines, lambda w, i: F.when((F.size(w) > 0) & (n(i + step) == 0), i)), lambda i: i.isNotNull())
    spans = F.filter(F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] < x["b"])
    blocks = F.transform(spans, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.flatten(F.slice(lines, x["a"] + 1, x["b"] - x["a"] + 1)).alias("w")))
    step = WINDOW // 2
    windows = F.transform(blocks, lambda x: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(x["w"]) - step - 1, F.lit(0)), F.lit(step)),
        lambda k: F.struct(x["a"].alias("paragraph"), x["b"].alias("last"), F.slice(x["w"], k + 1, WINDOW).alias("w"))))
    return F.concat(single, F.flatten(windows))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share): a row for each paragraph found to be a licence,
    ``paragraph`` being its place (from 0) among the lines of the text, or that of a block's first line."""
    spark = docs.sparkSession
    model = model or fit(sample_negatives(docs))
    keys = F.array(*[F.lit(k) for k in model.keys])
    texts = docs.select("doc_id", "text").where(F.arrays_overlap(_words(F.col("text")), keys))
    lines = texts.select(F.monotonically_increasing_id().alias("did"), "doc_id", F.transform(F.split("text", "\n"), _words).alias("ls"))
    lines = lines.select("did", "doc_id", F.explode_outer(_paragraphs(F.col("ls"))).alias("p"))
    lines = lines.select("did", "doc_id", "p.paragraph", "p.last", "p.w").where(F.arrays_overlap("w", keys))
    lines = cut_lineage(lines.select(F.monotonically_increasing_id().alias("rid"), "*"))
    two = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))),
                     lambda a, b: F.concat_ws(" ", a, b))
    two = F.when(F.size("w") > 1, two).otherwise(F.array().cast("array<string>"))
    place = ["did", "doc_id", "paragraph", "last"]
    lines = lines.select("rid", *place, "w", F.array_distinct(two).alias("pairs"))

    names = [f"c{k}" for k in range(len(model.families))]
    weights = spark.createDataFrame([(n, *v) for n, v in sorted(model.weights.items())], "feature string, " + ", ".join(f"{n} double" for n in names))
    found = lines.select("rid", F.explode(F.concat(F.array_distinct("w"), "pairs")).alias("feature"))
    logits = found.join(weights, "feature").groupBy("rid").agg(*[F.sum(n).alias(n) for n in names])
    z = [(F.coalesce(F.col(n), F.lit(0.0)) + b) * model.scale for n, b in zip(names, model.bias, strict=True)]
    scored = lines.select("rid", *place).join(logits, "rid", "left")
    scored = scored.select("rid", *place, F.array(*[F.struct(e.alias("z"), F.lit(f).alias("f")) for e, f in zip(z, model.families, strict=True)]).alias("z"))
    scored = scored.withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x["z"] - F.col("top")["z"]))
    scored = scored.select("rid", *place, F.col("top.f").alias("family"), (1 / total).alias("probability"))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY))

    templates = spark.createDataFrame([(f, k, len(pairs(w)), p) for k, (f, w) in enumerate(TEMPLATES) for p in sorted(pairs(w))],
                                      "t_family string, template int, size int, pair string")
    held = lines.select("rid", F.explode(F.concat("pairs", F.when(F.size("w") == 1, F.col("w")).otherwise(F.array().cast("array<string>")))).alias("pair"))
    held = held.join(templates, "pair").groupBy("rid", "t_family", "template").agg((F.count(F.lit(1)) / F.max("size")).alias("share"))
    held = held.groupBy("rid", "t_family").agg(F.max("share").alias("template_share")).where(F.col("template_share") >= MIN_TEMPLATE)
    out = cut_lineage(scored.join(held.withColumnRenamed("t_family", "family"), ["rid", "family"]))
    single = out.where("last IS NULL")
    best = F.max(F.struct("template_share", "probability")).alias("best")
    blocks = out.where("last IS NOT NULL").groupBy(*place, "family").agg(best)
    alone = single.select(F.col("did").alias("k_did"), F.col("family").alias("k_family"), F.col("paragraph").alias("k_line"))
    inside = (F.col("did") == F.col("k_did")) & (F.col("family") == F.col("k_family")) & F.col("k_line").between(F.col("paragraph"), F.col("last"))
    blocks = blocks.join(alone, inside, "left_anti").select("doc_id", "paragraph", "family", "best.probability", "best.template_share")
    return single.select(*blocks.columns).unionByName(blocks)
