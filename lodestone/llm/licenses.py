"""License scan: a trained paragraph classifier, confirmed by comparison with templates, in DataFrame operations only.

Paragraphs (lines) are described by the word 1- to 3-grams they share with the statements below, and by a class of the
number of their other words. Multinomial logistic regression tells license families from each other, from licensing
talk of no known family, and from other text. It is trained on the templates, on stretches of their words and variations
of their frames, and on all paragraphs of the corpus without a word of licensing; these weigh as much as
``other_weight`` examples together, however many they are. Each half of them, dealt by description, is scored by a model
that learned from the other half only; this calibrates the probability from which a family is believed, so that other
text passes it at most once in a thousand paragraphs. A believed family must also share enough of its n-grams with one
of the family's templates; a paragraph about licensing for which that fails is ``unknown``.

The texts are read once. What is left of them, known words and n-grams by run of lines, is stored; paragraphs of one
description are counted together and scored once.

Notices are also wrapped over lines. Runs of lines up to a blank one (or a bare comment mark) are read in overlapping
windows, of which one holds any stretch as long as the longest template. A window is of a family if it has enough of
a template's n-grams, most of those that no other family's templates have, and its version number.

Defined results: null text has no paragraphs; repeated rows are scanned each; families are listed once per document
in order of name; an empty table gives no rows. Paragraphs of any length are scored whole.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_checked, let, stored

# Statements by which the families are named or quoted.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
UNKNOWN = "unknown"
OTHER = "other"
# Licensing talk of no family above.
UNNAMED = [
    "All rights reserved. No part of this document may be reproduced without written permission.",
    "This software is licensed under a proprietary license; see the license agreement for terms.",
    "Licensed under the terms of the accompanying license agreement.",
    "Released under a custom license.",
    "Copyright holders grant a limited license to use this work for internal purposes only.",
    "Use of this work is subject to the license terms of its publisher.",
]
# Frames in which a named license is mentioned.
FRAMES = ("", "this file is ", "this project is ", "the software is ", "note: ")

#: Examples as which all other text together counts, if it has more paragraphs.
OTHER_WEIGHT = 3_000
#: Parts of words that paragraphs of other text must not have: it must hold no license.
TALK = ("licens", "licenc", "copyright", "spdx", "warrant", "redistribut", "rights reserved", "permission")
#: Classes of the number of words that no statement has: 0, 1, 2 to 3, 4 to 7, ...
SIZES = 7
#: Classes that a statement may have, as it may stand among other words.
AMONG = 4
#: Share of a template's n-grams that a paragraph must have.
CONTAINED = 0.6
#: Share that a window must have of the template's n-grams that no other family's templates have.
OWN = 0.7
#: Share of held-out other paragraphs that may pass for a family or for licensing talk.
FALSE_ALARMS = 0.001
#: Steps of the log-odds of being other text, per unit, in which paragraphs are counted, and the least log-odds told apart.
STEPS, LEAST = 100, -30


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, run, block) of the lines between blank ones; tie tells texts of one doc_id apart."""
    blank = r"\n[ \t\r\f\x0B\u00a0]*(?:[#*;%/!]+|--+|<!--+|--+>)?[ \t\r\f\x0B\u00a0]*(?=\n)"
    # The outer forms of explode here and below: the plain ones are evaluated again in a filter on the size.
    return docs.select(
        "doc_id", F.xxhash64("text").alias("tie"), F.posexplode_outer(F.split("text", blank)).alias("run", "block")
    )


def words_of(paragraph: Column) -> Column:
    """Of a paragraph in lower case."""
    return F.regexp_extract_all(paragraph, F.lit(r"[\p{L}\p{N}](?:[^\s]*[\p{L}\p{N}])?"), F.lit(0))


def grams(paragraph: Column) -> Column:
    """Word 1- to 3-grams in lower case, without marks at the ends of words."""
    return let(words_of(F.lower(paragraph)), spans)


def spans(w: Column) -> Column:
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))

    def joined(two: Column) -> Column:
        three = F.zip_with(
            F.slice(two, 1, F.greatest(n - 2, F.lit(0))),
            F.slice(w, 3, n),
            lambda a, b: F.concat_ws(" ", a, b),
        )
        return F.concat(w, two, three)

    return let(pairs, joined)


def size_class(n: Column) -> Column:
    return F.concat(F.lit("+"), F.when(n == 0, 0).otherwise(F.least(F.length(F.bin(n)), F.lit(SIZES - 1))))


def tokens_of(marked: Column, vocabulary: list[str]) -> Column:
    """Sorted n-grams of the vocabulary and size class of a paragraph whose words outside the vocabulary are empty."""
    n = F.size(marked)

    def with_next(a: Column, b: Column) -> Column:
        return F.when((a != "") & (b != ""), F.concat_ws(" ", a, b)).otherwise("")

    def found(two: Column) -> Column:
        three = F.zip_with(two, F.slice(marked, 3, n), with_next)
        return F.array_sort(F.array_distinct(F.filter(F.concat(marked, two, three), lambda g: g.isin(vocabulary))))

    known = let(F.zip_with(marked, F.slice(marked, 2, n), with_next), found)
    own = F.filter(marked, lambda x: x != "")
    known = F.when(F.size(own) < 2, own).otherwise(known)
    return F.concat(known, F.array(size_class(n - F.size(own))))


def read(docs: DataFrame, vocabulary: list[str], cue_words: list[str]) -> DataFrame:
    """(doc_id, tie, run, found) of the runs of lines, stored.

    found has lines, of those that have a word the tokens and whether they are plain, without a word of licensing; and
    words, all of the run, if a template may be among them. Words outside the vocabulary are empty.
    """
    single = [g for g in vocabulary if " " not in g]

    def marked(line: Column) -> Column:
        return F.transform(words_of(line), lambda x: F.when(x.isin(single), x).otherwise(""))

    def described(line: Column) -> Column:
        talk = F.lit(False)
        for part in TALK:
            talk = talk | line.contains(part)
        has = line.rlike(r"\w").alias("has")
        return let(marked(line), lambda w: F.struct(tokens_of(w, vocabulary).alias("tokens"), w.alias("w"), (~talk).alias("plain"), has))

    def found(lines: Column) -> Column:
        words = F.flatten(F.transform(lines, lambda x: x["w"]))
        lines = F.transform(F.filter(lines, lambda x: x["has"]), lambda x: F.struct(x["tokens"].alias("tokens"), x["plain"].alias("plain")))
        words = let(words, lambda w: F.when(F.exists(w, lambda x: x.isin(cue_words)), w))
        return F.struct(lines.alias("lines"), words.alias("words"))

    lines = F.transform(F.split(F.lower("block"), "\n"), described)
    return stored(runs(docs).select("doc_id", "tie", "run", let(lines, found).alias("found")), "runs")


def classes() -> list[str]:
    return [OTHER, UNKNOWN, *sorted(TEMPLATES)]


def _examples(spark: SparkSession) -> DataFrame:
    """(paragraph, label) from the templates: whole, framed, and without a few of their last words."""
    names = classes()
    rows = []
    for name, statements in [*TEMPLATES.items(), (UNKNOWN, UNNAMED)]:
        for statement in statements:
            words = statement.split()
            for frame in FRAMES:
                for cut in range(0, max(1, len(words) // 3)):
                    rows.append((frame + " ".join(words[: len(words) - cut]), float(names.index(name))))
    return spark.createDataFrame(rows, "paragraph string, label double").coalesce(1)


def vocabulary_of(spark: SparkSession) -> list[str]:
    """All n-grams of the examples: a fixed number."""
    found = _examples(spark).select(F.explode(grams(F.col("paragraph"))).alias("gram")).distinct()
    return sorted(r.gram for r in found.collect())


def vectors(vocabulary: list[str]) -> CountVectorizerModel:
    every = [*vocabulary, *[f"+{k}" for k in range(SIZES)]]
    return CountVectorizerModel.from_vocabulary(every, inputCol="tokens", outputCol="features", minTF=0.0).setBinary(True)


def train(counted: DataFrame, vocabulary: list[str], other_weight: int = OTHER_WEIGHT) -> tuple[LogisticRegressionModel, float]:
    """The classifier, and the probability of being other text under which a paragraph is taken for licensing talk.

    ``counted`` has the descriptions (tokens) of all paragraphs and n, the number of plain ones of each.
    """
    spark = counted.sparkSession
    vectorized = vectors(vocabulary)
    other = counted.where("n > 0").withColumn("fold", F.pmod(F.xxhash64("tokens"), F.lit(2)))
    totals = {r.fold: r.n for r in other.groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    total = sum(totals.values())

    among = F.explode(F.array(*[F.lit(f"+{k}") for k in range(AMONG)]))
    examples = _examples(spark).select("label", F.array_sort(F.array_distinct(grams(F.col("paragraph")))).alias("grams"), among.alias("size"))
    examples = examples.select("label", F.concat("grams", F.array("size")).alias("tokens"), F.lit(1.0 / AMONG).alias("weight"))

    def fitted(rows: DataFrame, n: int) -> LogisticRegressionModel:
        weight = F.col("n") * F.lit(min(1.0, other_weight / max(n, 1)))
        rows = rows.select(F.lit(0.0).alias("label"), "tokens", weight.alias("weight"))
        return LogisticRegression(
            family="multinomial", regParam=0.002, maxIter=60, featuresCol="features", labelCol="label", weightCol="weight"
        ).fit(vectorized.transform(examples.union(rows)))

    model = fitted(other, total)
    if not total:
        return model, 0.5
    low: dict[int, int] = {}
    for fold in (0, 1):
        of_others = fitted(other.where(F.col("fold") != fold), totals.get(1 - fold, 0))
        scored = of_others.transform(vectorized.transform(other.where(F.col("fold") == fold)))
        p = vector_to_array("probability")[0]
        step = F.floor(F.greatest(F.ln(p / (1 - p)), F.lit(float(LEAST))) * STEPS).cast("int")
        # a fixed number of steps, whatever the number of paragraphs
        for r in scored.where(p < 0.5).groupBy(step.alias("step")).agg(F.sum("n").alias("n")).collect():
            low[r.step] = low.get(r.step, 0) + r.n
    passed = 0
    for step, n in sorted(low.items()):
        passed += n
        if passed > FALSE_ALARMS * total:
            return model, 1 / (1 + math.exp(-step / STEPS))
    return model, 0.5


def _templates(spark: SparkSession) -> list[tuple[str, list[str], list[str], list[str]]]:
    """Per template: family, n-grams, those of no other family, and pairs of words that hold a number."""
    rows = [(name, s) for name, statements in TEMPLATES.items() for s in statements]
    found = spark.createDataFrame(rows, "family string, paragraph string")
    found = [(r.family, set(r.grams)) for r in found.select("family", grams(F.col("paragraph")).alias("grams")).collect()]
    out = []
    for family, own in found:
        others = set().union(*[g for name, g in found if name != family])
        numbered = [g for g in own if g.count(" ") == 1 and any(c.isdigit() for c in g.split()[1])]
        out.append((family, sorted(own), sorted(own - others), numbered))
    return out


def cues(templates: list[tuple[str, list[str], list[str], list[str]]]) -> list[str]:
    """Words of which any text has one that contains enough of a template: its longest, until the rest is too little."""
    out = set()
    for _, all_grams, _, _ in templates:
        words = sorted((g for g in all_grams if " " not in g), key=lambda w: (-len(w), w))
        while sum(not out & set(g.split(" ")) for g in all_grams) >= CONTAINED * len(all_grams):
            out.add(next(w for w in words if w not in out))
    return sorted(out)


def wrapped(found: DataFrame, templates: list, model: LogisticRegressionModel, vocabulary: list[str]) -> DataFrame:
    """(doc_id, tie, run, hit) of the runs of lines that hold a family's template; hit has family and probability."""
    span = max(sum(" " not in g for g in t[1]) for t in templates) * 2

    def constant(values: list[str]) -> Column:
        return F.split(F.lit("\n".join(values)), "\n") if values else F.array().cast("array<string>")

    # a fixed number of templates, as constants of the plan
    fields = ("known", "own", "numbered")
    rows = [[F.lit(t[0]).alias("family"), *[constant(v).alias(f) for f, v in zip(fields, t[1:], strict=True)]] for t in templates]
    known = F.array(*[F.struct(*row) for row in rows])
    union = constant(sorted({g for t in templates for g in t[1]}))
    least = min(CONTAINED * len(t[1]) for t in templates)

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - span - 1, F.lit(0)), F.lit(span))
        return F.transform(starts, lambda at: F.slice(w, at + 1, F.lit(2 * span)))

    def held(t: Column) -> Column:
        def common(of: str) -> Column:
            return F.size(F.array_intersect("common", t[of]))

        enough = (common("known") >= CONTAINED * F.size(t["known"])) & (common("own") >= OWN * F.size(t["own"]))
        return enough & (common("numbered") == F.size(t["numbered"]))

    cut = found.where("found.words is not null").select("doc_id", "tie", "run", F.col("found.words").alias("words"))
    cut = cut.select("doc_id", "tie", "run", F.explode_outer(windows(F.col("words"))).alias("words"))
    # One intersection with the n-grams of all templates; what is left of a window is short.
    cut = cut.select("doc_id", "tie", "run", F.array_intersect(spans(F.col("words")), union).alias("common"))
    cut = cut.where(F.size("common") >= least)
    cut = cut.select("doc_id", "tie", "run", "common", F.explode(F.filter(known, held)).alias("t"))
    tokens = F.concat(F.array_intersect("common", "t.known"), F.array(size_class(F.lit(0)))).alias("tokens")
    cut = vectors(vocabulary).transform(cut.select("doc_id", "tie", "run", "t.family", tokens))
    listed = F.array(*[F.lit(n) for n in classes()])
    p = F.get(vector_to_array("probability"), (F.array_position(listed, F.col("family")) - 1).cast("int"))
    return model.transform(cut).groupBy("doc_id", "tie", "run", "family").agg(F.max(p).alias("p")).select(
        "doc_id", "tie", "run", F.struct("family", "p").alias("hit")
    )


def license_scan(docs: DataFrame, other_weight: int = OTHER_WEIGHT) -> DataFrame:
    """(doc_id, licenses, n_licensed, n_unknown, best) of ``docs`` (doc_id, text).

    licenses: families that are confirmed, joined by commas; n_licensed and n_unknown: paragraphs of a confirmed
    family and of licensing talk without one (a run of lines that holds a family which no single line of the document
    shows is one paragraph, and its lines are none of unknown family); best: the highest probability of a confirmed family, 0 if there is none.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    vocabulary, by_template = vocabulary_of(spark), _templates(spark)
    found = read(docs, vocabulary, cues(by_template))
    lines = found.select("doc_id", "tie", "run", F.explode(F.col("found.lines")).alias("line"))
    lines = lines.select("doc_id", "tie", "run", "line.tokens", "line.plain")
    counted = stored(lines.groupBy("tokens").agg(F.count_if("plain").alias("n")), "described")
    model, limit = train(counted, vocabulary, other_weight)
    names = classes()
    # one row per family: a fixed number
    rows = [(name, s) for name, statements in TEMPLATES.items() for s in statements]
    known = spark.createDataFrame(rows, "family string, paragraph string")
    known = known.groupBy("family").agg(F.collect_list(grams(F.col("paragraph"))).alias("templates"))

    scored = model.transform(vectors(vocabulary).transform(counted)).where(vector_to_array("probability")[0] < limit)
    scored = scored.select("tokens", vector_to_array("probability").alias("p"))
    family = F.slice("p", 3, len(names) - 2)
    best = F.array_max(family)
    listed = F.array(*[F.lit(n) for n in names[2:]])
    guess = let(best, lambda b: F.struct(listed[(F.array_position(family, b) - 1).cast("int")].alias("family"), b.alias("p")))
    scored = scored.select("tokens", guess.alias("guess"))
    scored = scored.join(F.broadcast(known), F.col("guess.family") == F.col("family"))
    share = F.transform(
        "templates", lambda t: F.size(F.array_intersect("tokens", t)) / F.size(F.array_distinct(t))
    )
    confirmed = F.coalesce(F.array_max(share), F.lit(0.0)) >= CONTAINED
    hits = stored(scored.select("tokens", F.when(confirmed, F.col("guess")).alias("hit")), "hits")
    scored = lines.join(broadcast_checked(hits), "tokens")
    scored = scored.select("doc_id", "tie", "run", "hit", F.lit(False).alias("joined"))
    scored = scored.unionByName(wrapped(found, by_template, model, vocabulary).withColumn("joined", F.lit(True)))
    line, single = ~F.col("joined"), F.col("hit.family").isNotNull() & ~F.col("joined")
    # rows per run first: a run of a family leaves no unknown lines
    by_run = scored.groupBy("doc_id", "tie", "run").agg(
        F.collect_set(F.when(single, F.col("hit.family"))).alias("of_lines"),
        F.collect_set(F.when(F.col("joined"), F.col("hit.family"))).alias("of_run"),
        F.count_if(single).alias("n_hits"),
        F.count_if(line & F.col("hit").isNull()).alias("n_open"),
        F.max("hit.p").alias("p"),
    )
    runs_of = F.flatten(F.collect_list("of_run"))
    hits = by_run.groupBy("doc_id", "tie").agg(
        F.array_distinct(F.flatten(F.collect_list("of_lines"))).alias("of_lines"),
        runs_of.alias("of_runs"),
        F.sum("n_hits").alias("n_hits"),
        F.sum(F.when(F.size("of_run") > 0, 0).otherwise(F.col("n_open"))).alias("n_unknown"),
        F.max("p").alias("best"),
    )
    more = F.size(F.filter("of_runs", lambda f: ~F.array_contains("of_lines", f)))
    hits = hits.select(
        "doc_id",
        "tie",
        F.array_sort(F.array_union("of_lines", "of_runs")).alias("families"),
        (F.col("n_hits") + more).alias("n_licensed"),
        "n_unknown",
        "best",
    )
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "families", "n_licensed", "n_unknown", "best")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"))
    return rows.join(hits, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie")), "left").select(
        "doc_id",
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("licenses"),
        F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
        F.coalesce("best", F.lit(0.0)).alias("best"),
    )
