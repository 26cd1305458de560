"""Licence notices in documents: a trained paragraph classifier, confirmed by templates.

Everything is DataFrame and SQL code. Known notices and their parts are the training paragraphs of
each licence family, legal-sounding sentences and paragraphs of the corpus are the "unknown" class.
A multinomial logistic regression over single words and word pairs is trained by gradient rounds,
each two small joins and sums. Paragraphs are lines; they are cut into sentences, and long sentences
into overlapping windows of words, so notices that share a line are told apart. Every window of every
document is scored by joining its n-grams with the weight table, whose size is set by the notices and
not by the corpus; a family counts when its calibrated probability passes the limit that held-out
unknown windows set, and is confirmed when the window shares enough word pairs with one of its notices.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import keep, text_of

#: Wording of well-known licence notices by family (public texts).
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT"),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPL v2.1.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL v3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC-ND 4.0, a Creative Commons NonCommercial license.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.", "Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary.",
        "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"),
}
UNKNOWN = "unknown"
#: Legal-sounding text that names no licence family.
NO_NOTICES: tuple[str, ...] = (
    "All rights reserved.", "Copyright the authors. All rights reserved.", "See the license agreement for details.",
    "Use of this service is subject to the terms of use and the privacy policy.", "You must have a driving license to work here.",
    "This article was published under the terms of the agreement between the parties.", "No part of this work may be reproduced without written permission of the publisher.",
    "The license fee is due at the end of each year.", "Permission to enter the building is granted by the office.",
    "The software is available in version 2.0 and later versions.", "The public is invited to attend the general meeting.",
    "This program is free and open to the public.", "The work is distributed to any person who asks for it.",
    "We use cookies to provide our services and to analyse traffic.", "The foundation published a list of the conditions.",
)
FAMILIES = (*NOTICES, UNKNOWN)
#: Documents and paragraphs of the corpus that training takes at most, gradient rounds, step, weight decay.
SAMPLE_DOCUMENTS = 400
SAMPLE_PARAGRAPHS = 4000
ROUNDS = 12
STEP = 0.7
DECAY = 0.002
#: Where a sentence ends, and the words a window has at most; windows of a longer sentence overlap by half.
SENTENCE_END = r"(?<=[.!?])\s+"
WINDOW = 64
#: Counts packed into one long, and the bits of each.
TALLIES = 8
TALLY_BITS = 8
#: Least probability of a family, and least share of word pairs with a notice.
LEAST = 0.5
OVERLAP = 0.5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def windows(found: Column) -> Column:
    """The words of a sentence as one window, or as several that overlap by half."""
    half = WINDOW // 2
    last = F.ceil((F.size(found) - WINDOW) / half).cast("int")
    return F.when(F.size(found) <= WINDOW, F.array(found)).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(found, i * half + 1, F.lit(WINDOW))))


def n_grams(found: Column) -> Column:
    """Single words and pairs of neighbours."""
    size = F.size(found)
    pairs = F.zip_with(F.slice(found, F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice(found, F.lit(2), F.greatest(size - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(found, pairs)


def _notices(spark: SparkSession) -> DataFrame:
    """(notice, family, text) of the wordings above."""
    rows = [(f, t) for f, texts in (*NOTICES.items(), (UNKNOWN, NO_NOTICES)) for t in texts]
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(rows)], "notice int, family string, text string")


def training_paragraphs(docs: DataFrame) -> DataFrame:
    """(example, family, gram, held): notices, their sentences, halves and thirds, and windows of the corpus.

    Corpus paragraphs, cut like those that are scored, come from ``SAMPLE_DOCUMENTS`` documents by order of a hash and are unknown,
    unless half of their word pairs are a notice's: those are left out. A fifth of the examples is
    held for calibration.
    """
    spark = docs.sparkSession
    notices = _notices(spark).withColumn("words", words(F.col("text")))
    size = F.size("words")
    parts = [F.col("words")] + [
        F.slice("words", F.floor(size * i / n).cast("int") + 1, F.greatest(F.ceil(size / n).cast("int"), F.lit(3)))
        for n in (2, 3) for i in range(n)]
    known = notices.select("family", F.explode(F.array(*parts)).alias("words")).unionByName(
        notices.select("family", F.explode(F.split("text", SENTENCE_END)).alias("text")).select("family", words(F.col("text")).alias("words"))
    ).where(F.size("words") >= 2)
    at = F.xxhash64("doc_id").alias("at")
    picked = docs.select(at).distinct().orderBy("at").limit(SAMPLE_DOCUMENTS)
    sample = docs.select(text_of(docs).alias("text"), at).join(F.broadcast(picked), "at", "left_semi")
    lines = sample.select(F.explode(F.split("text", "\n")).alias("text")).orderBy(F.xxhash64("text"), "text").limit(SAMPLE_PARAGRAPHS)
    corpus = (
        lines.select(F.explode(F.split("text", SENTENCE_END)).alias("text")).select(words(F.col("text")).alias("words"))
        .select(F.explode(windows(F.col("words"))).alias("words")).where(F.size("words") > 0)
    )
    pairs = notices.where(F.col("family") != UNKNOWN).select(
        F.explode(n_grams(F.col("words"))).alias("gram")).where("gram like '% %'").distinct().orderBy("gram").collect()
    of_notices = F.array(*[F.lit(r["gram"]) for r in pairs])  # as many as the fixed wordings have
    own = F.filter(n_grams(F.col("words")), lambda g: g.contains(" "))
    strange = corpus.where(
        F.size(F.array_intersect(own, of_notices)) * 2 < F.greatest(F.size(own), F.lit(1))).select(F.lit(UNKNOWN).alias("family"), "words")
    example = F.xxhash64("family", "words")
    return (
        known.unionByName(strange).select(example.alias("example"), "family", "words").dropDuplicates(["example"])
        .select("example", "family", (F.pmod("example", F.lit(5)) == 0).alias("held"), F.explode(F.array_distinct(n_grams(F.col("words")))).alias("gram"))
    )


def _columns(prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in range(len(FAMILIES))]


def _scores(examples: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of weights by ``keys``; the empty n-gram stands for the bias."""
    return examples.join(F.broadcast(weights), "gram").groupBy(*keys).agg(*[F.sum(w).alias(w) for w in _columns("w")])


def _probabilities(scores: DataFrame) -> DataFrame:
    top = F.greatest(*_columns("w"))
    powers = [F.exp(F.col(w) - top) for w in _columns("w")]
    total = sum(powers[1:], powers[0])
    return scores.withColumns({p: e / total for p, e in zip(_columns("p"), powers)})


def train(docs: DataFrame) -> tuple[DataFrame, float]:
    """(gram, w0, w1, ...) with a weight per family, and the probability a family must reach.

    Features are n-grams of the notices that fewer than one in fifty unknown paragraphs have; so
    the table's size is bounded by the notices' text. Training starts from log-ratios of smoothed
    counts and takes ``ROUNDS`` full gradient steps; families weigh alike. The examples are few by
    the bounds above and lie in one partition, so a round needs no shuffle.
    """
    every = keep(training_paragraphs(docs), "licence-examples")
    strange = every.where(F.col("family") == UNKNOWN)
    n_strange = strange.select("example").distinct().count()
    common = strange.groupBy("gram").count().where(F.col("count") > max(n_strange / 50, 2)).select("gram")
    features = every.where(F.col("family") != UNKNOWN).select("gram").distinct().join(F.broadcast(common), "gram", "left_anti")
    bias = every.select("example", "family", "held").distinct().withColumn("gram", F.lit(""))
    used = keep(every.join(F.broadcast(features), "gram").select("example", "family", "held", "gram").unionByName(bias), "licence-features")
    sizes = used.where("not held and gram = ''").groupBy("family").agg(F.count("*").alias("n"))
    fit = keep(used.where("not held").join(F.broadcast(sizes), "family").withColumn("share", 1.0 / F.col("n")).drop("n", "held"), "licence-fit").coalesce(1)
    by_family = {f: F.sum(F.when(F.col("family") == f, F.col("share")).otherwise(0.0)) for f in FAMILIES}
    counts = fit.groupBy("gram").agg(F.count("*").alias("n"), *[by_family[f].alias(w) for f, w in zip(FAMILIES, _columns("w"))])
    mean = sum([F.log(F.col(w) + 0.02) for w in _columns("w")[1:]], F.log(F.col("w0") + 0.02)) / len(FAMILIES)
    weights = keep(counts.select("gram", "n", *[
        F.when(F.col("gram") == "", 0.0).otherwise((F.log(F.col(w) + 0.02) - mean) * 0.3).alias(w) for w in _columns("w")]), "licence-weights")
    for _ in range(ROUNDS):
        chance = _probabilities(_scores(fit, weights, ("example", "family", "share")))
        wrong = chance.select("example", "share", *[
            (((F.col("family") == f).cast("double") - F.col(p)) * F.col("share")).alias(e)
            for f, p, e in zip(FAMILIES, _columns("p"), _columns("e"))])
        slope = fit.select("example", "gram").join(F.broadcast(wrong), "example").groupBy("gram").agg(*[F.sum(e).alias(e) for e in _columns("e")])
        weights = keep(weights.coalesce(1).join(F.broadcast(slope), "gram").select("gram", "n", *[
            (F.col(w) * (1 - DECAY) + STEP * 4 * F.col(e)).alias(w) for w, e in zip(_columns("w"), _columns("e"))]), "licence-weights")
    held = _probabilities(_scores(used.where(F.col("held") & (F.col("family") == UNKNOWN)), weights, ("example",)))
    best = held.agg(F.percentile(F.greatest(*_columns("p")[:-1]), F.lit(0.995)).alias("limit")).first()["limit"]
    return weights.drop("n"), max(LEAST, float(best or 0.0))


def paragraph_findings(docs: DataFrame, weights: DataFrame, limit: float) -> DataFrame:
    """(row, doc_id, paragraph, window, family, probability, overlap): windows of a licence family.

    Paragraphs are lines, ``window`` tells the windows of one apart. Each document adds one row with paragraph -1 and no family, so that all
    documents are there. ``row`` numbers the rows of ``docs``. Pairs shared with each notice are tallied with the weights in one
    aggregation: a long holds ``TALLIES`` counts, and a window has fewer than ``WINDOW`` pairs, so none runs over into the next.
    """
    spark = docs.sparkSession
    notices = _notices(spark).where(F.col("family") != UNKNOWN).withColumn("words", words(F.col("text")))
    gram_of = notices.select("notice", "family", F.explode(F.array_distinct(n_grams(F.col("words")))).alias("gram")).where("gram like '% %'")
    sizes = gram_of.groupBy("notice", "family").agg(F.count("*").alias("pairs")).orderBy("notice").collect()  # one row per fixed wording
    tallies = [f"m{j}" for j in range(max(r["notice"] for r in sizes) // TALLIES + 1)]
    one = F.expr(f"shiftleft(1L, cast(notice % {TALLIES} * {TALLY_BITS} as int))")
    marks = gram_of.groupBy("gram").agg(*[
        F.sum(F.when(F.floor(F.col("notice") / TALLIES) == j, one).otherwise(0)).alias(m) for j, m in enumerate(tallies)])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    lines = numbered.select("row", "doc_id", F.posexplode(
        F.concat(F.split("text", "\n"), F.array(F.lit(None).cast("string")))).alias("paragraph", "line"))
    sentences = lines.select(
        "row", "doc_id", F.when(F.col("line").isNull(), -1).otherwise(F.col("paragraph")).alias("paragraph"),
        F.posexplode_outer(F.split("line", SENTENCE_END)).alias("sentence", "text")).withColumn("words", words(F.col("text")))
    found = sentences.select(
        "row", "doc_id", "paragraph", "sentence", F.posexplode_outer(windows(F.col("words"))).alias("part", "words")).withColumn(
        "window", F.coalesce(F.shiftleft(F.col("sentence").cast("bigint"), 32) + F.col("part"), F.lit(0).cast("bigint")))
    grams = found.select("row", "doc_id", "paragraph", "window", F.size("words").alias("n_words"), F.explode(
        F.when(F.col("words").isNull(), F.array(F.lit(""))).otherwise(F.array_distinct(n_grams(F.col("words"))))).alias("gram"))
    table_of = keep(weights.join(marks, "gram", "full").select("gram", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in (*tallies, *_columns("w"))]), "licence-table")
    bias = weights.where("gram = ''").select(*_columns("w")).first() or [0.0] * len(FAMILIES)
    per = grams.join(F.broadcast(table_of), "gram").groupBy("row", "doc_id", "paragraph", "window", "n_words").agg(
        *[F.sum(m).alias(m) for m in tallies],
        *[(F.sum(w) + F.when(F.col("paragraph") >= 0, b).otherwise(0.0)).alias(w) for w, b in zip(_columns("w"), bias)])
    # the family of the greatest sum is the most probable one, so one probability is computed and not all of them
    top = F.greatest(*_columns("w"))
    powers = [F.exp(F.col(w) - top) for w in _columns("w")]
    best = F.greatest(*[F.struct(F.col(w).alias("w"), F.lit(f).alias("family")) for w, f in zip(_columns("w")[:-1], FAMILIES)])
    scored = per.withColumn("best", best).withColumn("probability", F.exp(F.col("best.w") - top) / sum(powers[1:], powers[0])).select(
        "row", "doc_id", "paragraph", "window", "n_words", *tallies, "probability",
        F.when((F.col("paragraph") >= 0) & (F.col("probability") >= limit), F.col("best.family")).alias("family"))
    both = [F.shiftright(tallies[r["notice"] // TALLIES], r["notice"] % TALLIES * TALLY_BITS).bitwiseAND(2 ** TALLY_BITS - 1) for r in sizes]
    overlap = F.greatest(F.lit(0.0), *[
        F.when(F.col("family") == r["family"], n / F.greatest(F.least(F.lit(r["pairs"]), F.col("n_words") - 1), F.lit(1))) for r, n in zip(sizes, both)])
    return scored.where("family is not null or paragraph = -1").select(
        "row", "doc_id", "paragraph", "window", "family", F.when(F.col("family").isNotNull(), F.col("probability")).alias("probability"), overlap.alias("overlap"))


def scan_licences(docs: DataFrame, fitted: tuple[DataFrame, float] | None = None) -> DataFrame:
    """One row per document: the licence families its paragraphs carry.

    doc_id; family (of the most probable confirmed window, "unknown" if a window is only
    classified, null if none is); families (all confirmed, sorted); paragraphs (with a classified
    window) and confirmed (of these, with the template's wording); probability (the highest). Two
    families named within one sentence count as the more probable one. ``fitted`` is what
    :func:`train` returned; without it the model is trained on ``docs``. Null texts are
    empty, have no family; repeated rows and null ids give a row each; further columns are ignored.
    """
    weights, limit = fitted or train(docs)
    found = paragraph_findings(docs, weights, limit)
    sure = F.col("family").isNotNull() & (F.col("overlap") >= OVERLAP)
    per = found.groupBy("row", "doc_id").agg(
        F.max(F.when(sure, F.struct("probability", "family"))).alias("top"),
        F.sort_array(F.collect_set(F.when(sure, F.col("family")))).alias("families"),
        F.count_distinct(F.when(F.col("family").isNotNull(), F.col("paragraph"))).alias("paragraphs"),
        F.count_distinct(F.when(sure, F.col("paragraph"))).alias("confirmed"), F.max("probability").alias("probability"))
    return per.select(
        "doc_id", F.coalesce("top.family", F.when(F.col("paragraphs") > 0, F.lit(UNKNOWN))).alias("family"), "families",
        "paragraphs", "confirmed", "probability")
