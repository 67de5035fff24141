"""Licence notices: a trained paragraph classifier, confirmed against templates, in DataFrame functions throughout."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage.llm.common import Scratch, ascii_lower, hash_bound, text_key

# The usual notices of each family
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
            "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
            "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
)
UNKNOWN = "unknown"
FALSE_ALARMS, COVER = 0.001, 0.5
# Words of a window that the classifier judges, and words between the starts of two windows: a notice of up to 17 words lies whole in one
WINDOW, STEP = 32, 16
# A word or pair of words in more than this share of the windows of unknown text says nothing about licences and is no feature
COMMON = 0.01
# Weights are whole multiples of 1 / SCALE, so that sums do not depend on their order
SCALE = 1 << 20


def words(line: Column) -> Column:
    return F.filter(F.split(ascii_lower(line), "[^a-z0-9]+"), lambda w: w != "")


def pairs(found: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    n = F.greatest(F.size(found) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(found, 1, n), F.slice(found, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))


def ngrams(found: Column) -> Column:
    return F.array_distinct(F.concat(found, pairs(found)))


def located(text: Column) -> Column:
    """Words of a text with their lines, numbered from 0. Line breaks and comment marks part words as blanks do, so that wrapped text reads on."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda x, i: F.transform(words(x), lambda w: F.struct(w.alias("word"), i.alias("line")))))


def texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text_key, located) of each text."""
    return docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias("text_key"), located(F.col(text)).alias("located"))


def templates(spark: SparkSession, scratch: Scratch) -> DataFrame:
    rows = spark.createDataFrame([(i, family, text) for i, (family, text) in enumerate(TEMPLATES)], "template int, family string, paragraph string")
    return scratch.put(rows.select("template", "family", words(F.col("paragraph")).alias("words")).coalesce(1))


def places(rows: DataFrame, known: DataFrame, cover: float) -> DataFrame:
    """(row, family, cover, start, end, line, last): where a text holds at least ``cover`` of the pairs of words of a family's template.

    From each pair that a template has, a window of a quarter more words than the template (and eight) is read across line breaks, up to the last pair it adds.
    Of windows of a family that overlap, the one with the largest cover stays, then the shortest. Words from start to end (exclusive) of the text are the notice.
    """
    wanted = known.select("template", "family", (F.size("words") * 5 / 4 + 8).cast("int").alias("width"), F.size(pairs(F.col("words"))).alias("n"),
                          F.posexplode(pairs(F.col("words"))).alias("k", "pair"))
    n = F.greatest(F.size("located") - 1, F.lit(0))
    both = F.zip_with(F.slice("located", 1, n), F.slice("located", 2, n), lambda a, b: F.struct(
        F.concat(a["word"], F.lit(" "), b["word"]).alias("pair"), a["line"].alias("line"), b["line"].alias("last")))
    hits = rows.select("row", F.posexplode(both).alias("at", "both")).select("row", "at", "both.*").join(F.broadcast(wanted), "pair")
    found = hits.groupBy("row", "template", "family", "n", "width").agg(F.array_sort(F.collect_list(F.struct("at", "k", "line", "last"))).alias("hits")) \
        .filter(F.size(F.array_distinct("hits.k")) >= F.col("n") * cover)

    def window(first: Column, i: Column) -> Column:
        near = F.filter(F.slice("hits", i + 1, F.col("width")), lambda x: x["at"] < first["at"] + F.col("width"))
        kinds = F.transform(near, lambda x: x["k"])
        return F.struct(first.alias("first"), near.alias("near"), kinds.alias("kinds"), F.array_distinct(kinds).alias("distinct"))

    def place(w: Column) -> Column:
        last = F.element_at(w["near"], F.array_position(w["kinds"], F.element_at(w["distinct"], -1)).cast("int"))
        return F.struct((-F.size(w["distinct"]) / F.col("n")).alias("cover"), (last["at"] - w["first"]["at"]).alias("length"), w["first"]["at"].alias("start"),
                        (last["at"] + 2).alias("end"), w["first"]["line"].alias("line"), last["last"].alias("last"))
    enough = F.filter(F.transform("hits", window), lambda w: F.size(w["distinct"]) >= F.col("n") * cover)
    every = found.select("row", "family", F.transform(enough, place).alias("places")).groupBy("row", "family").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    none = F.filter("places", lambda x: F.lit(False))
    chosen = F.aggregate("places", none, lambda kept, x: F.when(F.exists(kept, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), kept).otherwise(F.concat(kept, F.array(x))))
    return every.select("row", "family", F.explode(chosen).alias("place")).select("row", "family", (-F.col("place.cover")).alias("cover"), "place.start", "place.end", "place.line", "place.last")


def starts(n: Column) -> Column:
    """Where the windows of a text of n words start; a short text is one window."""
    last = F.greatest(F.ceil((n - WINDOW) / STEP), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * STEP)


def windows(rows: DataFrame) -> DataFrame:
    """``rows`` with a column words, once for each window of its words, with the window's start."""
    return rows.withColumn("start", F.explode(starts(F.size("words")))).withColumn("words", F.slice("words", F.col("start") + 1, F.lit(WINDOW)))


class Model:
    """Weights by n-gram (those of the features that have any), intercepts by family, the unknown class last, and the least probability of a licence."""

    def __init__(self, families: list[str], weights: list[tuple[str, list[float]]], intercepts: list[float], scratch: Scratch):
        self.families, self.least = families, 0.5
        self.rows = [(g, [round(x * SCALE) for x in w]) for g, w in weights]
        self.intercepts = [round(b * SCALE) for b in intercepts]
        self.weights = scratch.put(scratch.spark.createDataFrame(self.rows, "ngram string, w array<long>").coalesce(1))

    def judged(self, hits: DataFrame, *key: str) -> DataFrame:
        """(key, family, probability): for each key, with the n-grams found there, the likeliest licence and the probability that it is any licence."""
        found = hits.select(*key, "ngram").distinct().join(F.broadcast(self.weights), "ngram")
        scores = found.groupBy(*key).agg(F.array(*[F.sum(F.col("w")[i]) + F.lit(b) for i, b in enumerate(self.intercepts)]).alias("z"))
        shares = scores.select(*key, F.transform("z", lambda x: F.exp((x - F.array_max("z")) / SCALE)).alias("e")) \
            .select(*key, F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))
        best = F.array_max(F.slice("p", 1, len(self.families) - 1))
        names = F.array(*map(F.lit, self.families))
        return shares.select(*key, F.element_at(names, F.array_position("p", best).cast("int")).alias("family"), (1 - F.element_at("p", -1)).alias("probability"))

    def predicted(self, rows: DataFrame) -> DataFrame:
        """(row, family, probability) of runs of words."""
        return self.judged(rows.select("row", F.explode(ngrams(F.col("words"))).alias("ngram")), "row")

    def support(self) -> tuple[dict[str, int], float]:
        """What each n-gram can add to the margin of a licence over the unknown class, and the sum that a passing window reaches at the least: its best margin is at least the
        logarithm of the odds of ``least`` less that of the number of families, and the intercepts are there without any n-gram."""
        gains = {g: max(x - w[-1] for x in w[:-1]) for g, w in self.rows}
        start = max(b - self.intercepts[-1] for b in self.intercepts[:-1])
        return {g: x for g, x in gains.items() if x > 0}, (math.log(self.least / (1 - self.least)) - math.log(len(self.families) - 1) - 1e-6) * SCALE - start if self.least < 1 else math.inf


class Codes:
    """Numbers of the n-grams of the templates: of words from 1, those that templates have most first; of pairs of words from above the words."""

    def __init__(self, known: DataFrame):
        rows = [r["words"] for r in known.collect()]
        found: dict[str, int] = {}
        for row in rows:
            for w in row:
                found[w] = found.get(w, 0) + 1
        self.words = sorted(found, key=lambda w: (-found[w], w))
        self.base = len(self.words) + 1
        number = {w: i for i, w in enumerate(self.words, 1)}
        self.templates = [sorted({number[a] * self.base + number[b] for a, b in zip(row, row[1:])}) for row in rows]
        self.pairs = sorted({p for t in self.templates for p in t})
        self.names = {i: w for w, i in number.items()} | {p: f"{self.words[p // self.base - 1]} {self.words[p % self.base - 1]}" for p in self.pairs}

    def of_words(self, found: Column) -> Column:
        """The number of each word, 0 for words that no template has."""
        places = F.array(*map(F.lit, self.words))
        return F.transform(found, lambda w: F.when(w.isin(*self.words), F.array_position(places, w).cast("int")).otherwise(F.lit(0)))

    def of_pairs(self, codes: Column) -> Column:
        n = F.greatest(F.size(codes) - 1, F.lit(0))
        return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.when((a > 0) & (b > 0) & (a * self.base + b).isin(*self.pairs), a * self.base + b).otherwise(F.lit(0)))

    def may_hold(self, pairs: Column, cover: float) -> Column:
        """Whether a text has so large a share of the pairs of words of any template."""
        distinct = F.array_distinct(F.filter(pairs, lambda p: p > 0))
        return F.transform(F.array(distinct), lambda own: F.reduce(F.array(*[F.struct(F.array(*map(F.lit, t)).alias("t"), F.lit(len(t) * cover).alias("least")) for t in self.templates]), F.lit(False),
                           lambda yes, t: yes | ((F.size(own) >= t["least"]) & (F.size(F.array_intersect(own, t["t"])) >= t["least"]))))[0]

    def ngrams(self, codes: Column) -> Column:
        names = F.create_map(*[F.lit(x) for c in sorted(self.names) for x in (c, self.names[c])])
        return F.transform(codes, lambda c: F.try_element_at(names, c))


def unknown_windows(docs: DataFrame, known: DataFrame, codes: Codes, scratch: Scratch, text: str) -> DataFrame:
    """(train, grams): the numbers of the templates' n-grams in each distinct window of all texts that shares no words with half a template, by turns for training and not.

    Texts are read once; what stays of them is numbers: of words and pairs that templates have, and a hash of each window, by which equal windows are told.
    """
    coded = docs.select(F.transform(F.array(words(F.col(text))), lambda w: F.struct(w.alias("words"), codes.of_words(w).alias("codes")))[0].alias("w"), F.col(text).alias("text")) \
        .filter(F.size("w.words") > 0)
    paired = coded.select("w", "text", codes.of_pairs(F.col("w.codes")).alias("pairs"))
    hashes = F.transform(starts(F.size("w.words")), lambda at: F.xxhash64(F.slice("w.words", at + 1, F.lit(WINDOW))))
    rows = scratch.put(paired.select(F.monotonically_increasing_id().alias("row"), F.col("w.codes").alias("codes"), "pairs", hashes.alias("hashes"),
                                     F.when(codes.may_hold(F.col("pairs"), 0.5), located(F.col("text"))).alias("located")))
    first = F.greatest(F.floor((F.col("start") - WINDOW) / STEP).cast("int") + 1, F.lit(0))
    notices = places(rows.filter("located is not null").select("row", "located"), known, 0.5) \
        .select("row", F.explode(F.sequence(first, F.floor((F.col("end") - 1) / STEP).cast("int"))).alias("k")).distinct()
    at = F.col("k") * STEP + 1
    cut = rows.drop("located").select("row", "codes", "pairs", F.posexplode("hashes").alias("k", "bits")).select("row", "k", "bits", F.array_distinct(F.filter(
        F.concat(F.slice("codes", at, F.lit(WINDOW)), F.slice("pairs", at, F.lit(WINDOW - 1))), lambda c: c > 0)).alias("grams"))
    return scratch.put(cut.join(notices, ["row", "k"], "left_anti").select("bits", "grams").distinct().select((F.pmod("bits", F.lit(2)) == 0).alias("train"), "grams"))


def fit(docs: DataFrame, known: DataFrame, scratch: Scratch, key: str, text: str, false_alarms: float = FALSE_ALARMS, common: float = COMMON) -> Model:
    """Train on windows of the templates, whole and without every eighth or fourth word in turn (words of one family alone stay), and on the windows of all documents as the unknown class.

    Windows that share words with half a template, wrapped or not, are no unknown text. Half the distinct windows train and tell which n-grams are ``common``; on the other half the
    least probability of a licence is set so that at most a ``false_alarms`` share passes. Windows with the same features are one row with their number as its weight, so the
    fit and the calibration go over the distinct sets of features, although they count every window.
    """
    families = sorted({f for f, _ in TEMPLATES}) + [UNKNOWN]
    codes = Codes(known)
    pool = unknown_windows(docs, known, codes, scratch, text)
    sizes = {r["train"]: r["count"] for r in pool.groupBy("train").count().collect()}
    n_trained, n_held = sizes.get(True, 0), sizes.get(False, 0)
    often = {r["gram"] for r in pool.filter("train").select(F.explode("grams").alias("gram")).groupBy("gram").count().filter(F.col("count") > common * n_trained).collect()}
    features = sorted(codes.names.keys() - often)
    vocabulary = sorted(codes.names[c] for c in features)
    sets = scratch.put(pool.select("train", F.array_sort(F.filter("grams", lambda c: ~c.isin(*often) if often else F.lit(True))).alias("grams")).groupBy("train", "grams").count())
    scratch.drop(pool)
    trained = sets.filter("train")
    # a word that one family alone has tells it from the others and stays
    own = known.select("family", F.explode("words").alias("word")).distinct().groupBy("word").count().filter(F.col("count") == 1)
    own = sorted(r["word"] for r in own.collect())
    gaps = F.inline(F.array(*[F.struct(F.lit(every).alias("every"), F.lit(cut).alias("cut")) for every in (8, 4) for cut in range(-1 if every == 8 else 0, every)]))
    variants = windows(known.select("family", "words", gaps).select("family", F.filter("words", lambda w, i: ((i % F.col("every")) != F.col("cut")) | w.isin(*own)).alias("words"))).select("family", "words")
    # the unknown class weighs as much as the licences; how much of it passes is for the least probability to say
    balance = min(1.0, variants.count() / max(1, n_trained))
    data = variants.select(F.lit(1.0).alias("weight"), "family", ngrams(F.col("words")).alias("ngrams")) \
        .unionAll(trained.select(F.col("count") * balance, F.lit(UNKNOWN), codes.ngrams(F.col("grams")))) \
        .select("weight", (F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1).cast("double").alias("label"), "ngrams")
    parts = trained.count() // 50_000 + 1
    data = data.coalesce(parts).sortWithinPartitions("label", "ngrams")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="ngrams", outputCol="features")
    fitted = LogisticRegression(family="multinomial", elasticNetParam=0.5, regParam=0.001, maxIter=30, standardization=False, weightCol="weight").fit(vectors.transform(scratch.put(data)))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray().tolist()
    n = len(intercepts)  # without unknown text the last class is missing
    rows = [(w, matrix[:, i].tolist() + [0.0] * (len(families) - n)) for i, w in enumerate(vocabulary) if abs(matrix[:, i]).max() > 0]
    model = Model(families, rows, intercepts + [-100.0] * (len(families) - n), scratch)
    held = scratch.put(sets.filter("not train AND size(grams) > 0").withColumn("row", F.monotonically_increasing_id()))
    judged = model.judged(held.select("row", F.explode(codes.ngrams(F.col("grams"))).alias("ngram")), "row")
    allowed = int(n_held * false_alarms)
    worst = judged.join(held, "row").groupBy("probability").agg(F.sum("count").alias("n")).orderBy(F.desc("probability")).limit(allowed + 1).collect()
    model.least, passed = 0.5, 0
    for r in worst:
        passed += r["n"]
        if passed > allowed:
            model.least = max(0.5, math.nextafter(r["probability"], 2))
            break
    return model


def supported(found: Column, model: Model) -> Column:
    """Whether the n-grams of a text can bring any window of it over the least probability: a sum over the whole text, which no window exceeds."""
    gains, least = model.support()
    if least <= 0:
        return F.lit(True)
    if not gains or math.isinf(least):
        return F.lit(False)
    n = F.greatest(F.size(found) - 1, F.lit(0))
    every = F.concat(found, F.zip_with(F.slice(found, 1, n), F.slice(found, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))
    gain = F.create_map(*[F.lit(x) for g in sorted(gains) for x in (g, gains[g])])
    held = F.array_distinct(F.filter(every, lambda g: g.isin(*sorted(gains))))
    return F.aggregate(held, F.lit(0).cast("long"), lambda a, g: a + F.try_element_at(gain, g).cast("long")) >= F.lit(math.floor(least))


def likely(rows: DataFrame, model: Model) -> DataFrame:
    """(row, start): the windows of all texts that the classifier takes for a licence."""
    features = [g for g, _ in model.rows]
    n = F.greatest(F.size("words") - 1, F.lit(0))
    both = F.concat(F.transform("words", lambda w, i: F.struct(w.alias("ngram"), i.alias("at"), F.lit(1).alias("long"))),
                    F.zip_with(F.slice("words", 1, n), F.transform(F.slice("words", 2, n), lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                               lambda a, b: F.struct(F.concat(a, F.lit(" "), b["w"]).alias("ngram"), b["i"].alias("at"), F.lit(2).alias("long"))))
    hits = rows.select("row", F.transform("located", lambda w: w["word"]).alias("words")).select("row", F.explode(F.filter(both, lambda x: x["ngram"].isin(*features))).alias("x")).select("row", "x.*")
    # the windows that hold the hit; one beyond the last of a text holds nothing that its neighbour does not
    first = F.greatest(F.floor((F.col("at") + F.col("long") - 1 - WINDOW) / STEP).cast("int") + 1, F.lit(0))
    spread = hits.withColumn("k", F.explode(F.sequence(first, F.floor(F.col("at") / STEP).cast("int")))).select("row", (F.col("k") * STEP).alias("start"), "ngram")
    return model.judged(spread, "row", "start").filter(F.col("probability") >= model.least).select("row", "start")


def scan_licenses(docs: DataFrame, scratch: Scratch, cover: float = COVER, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, text_key, line, family, probability, cover): the licence notices of each text, with the line where each begins.

    All texts are read as words across line breaks and comment marks, in overlapping windows of 32. A multinomial logistic regression on words and pairs of words (an elastic net keeps
    the weights sparse) gives each window the probability of every family and of the unknown class; windows whose probability of being a licence reaches the calibrated least are
    looked at. There the templates confirm: a run of words that holds at least ``cover`` of the pairs of words of a template, and that overlaps such a window, is a
    notice if the regression, asked about the run alone, finds it likely enough and names the template's family. Of overlapping runs the one with more of its template stays, then the likelier, then
    the first name. So each notice of a line is reported, and the family is always the classifier's.

    Texts whose n-grams together could not bring a window to the least probability are left out first, by a bound that no window exceeds. Null and empty texts and texts without words have
    no notice; each row is scanned by itself, also if rows share an id or are equal; a null id is an id; further columns are not read; an empty table gives an empty
    table. Weights and templates have a few hundred rows, whatever the input.
    """
    known = templates(docs.sparkSession, scratch)
    model = fit(docs, known, scratch, key, text, **options)
    # a variable of a lambda is computed once, a column in a filter wherever it stands
    enough = F.transform(F.array(words(F.col(text))), lambda found: supported(found, model))[0]
    rows = scratch.put(texts(docs.filter(enough), key, text).withColumn("row", F.monotonically_increasing_id()))
    spotted = scratch.put(likely(rows, model))
    looked = rows.join(spotted.select("row").distinct(), "row", "left_semi")
    near = spotted.select("row", F.col("start").alias("_window"))
    runs = places(looked, known, cover).join(near, "row").filter((F.col("start") < F.col("_window") + WINDOW) & (F.col("_window") < F.col("end"))).drop("_window").distinct()
    spots = scratch.put(runs.withColumn("place", F.monotonically_increasing_id()))
    inside = spots.join(rows, "row").select(F.col("place").alias("row"), F.transform(F.slice("located", F.col("start") + 1, F.col("end") - F.col("start")), lambda w: w["word"]).alias("words"))
    judged = model.predicted(inside).filter(F.col("probability") >= model.least).select(F.col("row").alias("place"), F.col("family").alias("likeliest"), "probability")
    sure = scratch.put(spots.join(judged, "place").filter("family = likeliest").drop("likeliest"))
    other = sure.select("row", *(F.col(c).alias(f"_{c}") for c in ("family", "cover", "probability", "start", "end")))
    better = "struct(-_cover, -_probability, _family) < struct(-cover, -probability, family)"
    beaten = sure.join(other, "row").filter(f"family <> _family AND start < _end AND _start < end AND {better}").select("place").distinct()
    return rows.drop("located").join(sure.join(beaten, "place", "left_anti").drop("place"), "row").select("id", "text_key", F.col("line").cast("long").alias("line"), "family", "probability", "cover")
