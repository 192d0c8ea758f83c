"""Licence scans by a trained paragraph classifier, with DataFrame functions only.

Paragraphs (lines of a text) become counts-free vectors of the words and word pairs that the
notices have; no others can speak for a family.  A multinomial logistic regression with an L1
share, hence sparse, tells licence families from ``unknown``.  It is trained on variants of the
families' notices (a word left out or changed, words before and after) and on all distinct
paragraphs of the corpus that share no three words in a row with any notice.

``unknown`` is calibrated on all these paragraphs too: a family counts from the least
probability at which no more than ``FALSE_RATE`` of them pass, but not above the one that
``KNOWN_RATE`` of the variants of notices held out from training reach.
A prediction is then confirmed by comparing the paragraph with the family's notices: enough
of the shorter one's word triples must occur in the other, at least one.  Every text is cut
into words once; what follows works on the short vectors, and on the paragraphs that share a
triple with some notice.

Edge cases: null, empty and blank texts have no paragraphs; repeated rows each give a row;
an empty table gives an empty result; a very long paragraph, such as a whole text without
line breaks, is scored and compared whole; of equally likely families the first by name
counts; columns other than the named ones are not read."""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.llm.common import few, keep, small

UNKNOWN = "unknown"
#: Intervals that the probabilities are counted in when one of a rank is looked for.
BINS = 4096
FALSE_RATE = 0.0005
KNOWN_RATE = 0.95
#: Percent of the shorter text's word triples that the other must have.
CONFIRM = 50

#: The usual notices of each family.
NOTICES = {
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "apache": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0.",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
               "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD License.",
            "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
            "Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.",
              "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.",
                 "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.",
                 "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "gpl": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
            "You should have received a copy of the GNU General Public License along with this program.", "Released under the GPL.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
            "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
FAMILIES = (UNKNOWN, *sorted(NOTICES))
_WORDS = [re.findall("[a-z0-9]+", n.lower()) for ns in NOTICES.values() for n in ns]
#: The notices' words and word pairs, and their word triples.
VOCABULARY = sorted({t for w in _WORDS for t in (*w, *map(" ".join, zip(w, w[1:], strict=False)))})
TRIPLES = sorted({" ".join(w[i:i + 3]) for w in _WORDS for i in range(max(1, len(w) - 2))})


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))).otherwise(F.array().cast("array<string>"))


def pairs(w: Column) -> Column:
    """Neighbouring words, joined; linear in the words."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def triples(w: Column) -> Column:
    return F.array_distinct(F.when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(
        F.zip_with(pairs(F.slice(w, 1, F.size(w) - 1)), F.slice(w, 3, F.size(w) - 2), lambda a, b: F.concat(a, F.lit(" "), b))))


def features(rows: DataFrame) -> DataFrame:
    """``rows`` with ``features`` from ``words``."""
    both = rows.withColumn("_grams", F.concat("words", pairs(F.col("words"))))
    return CountVectorizerModel.from_vocabulary(VOCABULARY, "_grams", "features").setBinary(True).transform(both).drop("_grams")


def paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_row, _id, n_paragraphs and, a row each, ``pos`` and ``paragraph`` (both null in the one
    row of a text without any)."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda p: F.trim(p) != "")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), parts.alias("_p"))
    return rows.select("_row", "_id", F.size("_p").cast("long").alias("n_paragraphs"), F.posexplode_outer("_p").alias("pos", "paragraph"))


def notices(spark: SparkSession) -> DataFrame:
    known = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("paragraph")) for f, ns in sorted(NOTICES.items()) for n in ns])
    return spark.range(1).select(F.explode(known).alias("n")).select("n.*").withColumn("words", tokens(F.col("paragraph")))


def _variants(known: DataFrame, copies: int = 24) -> DataFrame:
    """Each notice as it is and with words left out or changed, by a hash of place and copy."""
    rows = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draw = lambda i: F.pmod(F.xxhash64("paragraph", "copy", i), F.lit(100))
    changed = F.transform("words", lambda w, i: F.when(F.col("copy") == 0, w).when(draw(i) < 4, F.lit(None)).when(draw(i) < 8, F.concat(F.lit("w"), draw(i).cast("string"))).otherwise(w))
    around = F.when(F.col("copy") % 3 == 2, F.split(F.lit("see notes of copy the file for details and"), " ")).otherwise(F.array().cast("array<string>"))
    return rows.select("family", "copy", F.concat(around, F.array_compact(changed)).alias("words"))


def described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``paragraphs`` with ``h`` (a hash of the paragraph), ``features`` and ``told`` (it shares a
    word triple with a notice); those have ``paragraph`` and ``words`` still."""
    rows = paragraphs(docs, doc_id, text).withColumn("words", tokens(F.coalesce("paragraph", F.lit(""))))
    rows = rows.withColumn("told", F.arrays_overlap(triples(F.col("words")), F.array(*map(F.lit, TRIPLES))))
    kept = [F.when(F.col("told"), F.col(c)).alias(c) for c in ("paragraph", "words")]
    return keep(features(rows).select("_row", "_id", "n_paragraphs", "pos", F.xxhash64("paragraph").alias("h"), "told", "features", *kept))


def percentile(values: DataFrame, share: float) -> float | None:
    """The exact percentile of the one column, as Spark's ``percentile`` gives it; only counts
    by BINS intervals a round reach the driver, until an interval has one value."""
    x = values.columns[0]
    n, least, most = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return None

    def ranked(k: int) -> float:
        lo, hi, before = least, most, 0
        while lo < hi:
            part = F.least(F.lit(BINS - 1), F.floor((F.col(x) - lo) / (hi - lo) * BINS))
            counts = values.where(F.col(x).between(lo, hi)).groupBy(part.alias("b")).agg(F.count(x).alias("c"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
            for row in sorted(counts, key=lambda r: r["b"]):
                lo, hi = row["lo"], row["hi"]
                if before + row["c"] > k:
                    break
                before += row["c"]
        return lo

    at = (n - 1) * share
    low, high = ranked(math.floor(at)), ranked(math.ceil(at))
    return low + (high - low) * (at - math.floor(at))


def learn(rows: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier of ``described`` rows, and the least probability at which a family counts."""
    free = keep(rows.where("pos is not null and not told").select("h", "features").dropDuplicates(["h"]).select("features"))
    n_unknown = free.count()
    free = few(free, n_unknown)
    family = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("double") - 1
    variants = _variants(notices(rows.sparkSession))
    told_apart = F.col("copy") % 6 == 5  # held out
    known = keep(features(variants.where(~told_apart)).select(family.alias("label"), "features", F.lit(1.0).alias("weight")))
    # unknown paragraphs weigh as much as all notices together, however many there are
    unknown = free.select(F.lit(0.0).alias("label"), "features", F.lit(known.count() / max(1, n_unknown)).alias("weight"))
    model = LogisticRegression(regParam=0.002, elasticNetParam=0.5, maxIter=60, family="multinomial", weightCol="weight").fit(few(known, 0).union(unknown))
    best = percentile(keep(score(model, free).select("family_p")), 1 - FALSE_RATE)
    reached = percentile(keep(predict(model, variants.where(told_apart).select("words")).select("family_p")), 1 - KNOWN_RATE)
    return model, min(max(0.5, best or 0.0), max(0.5, reached))


def train(docs: DataFrame, doc_id: str, text: str) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the least probability at which a family counts."""
    return learn(described(docs, doc_id, text))


def predict(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the likeliest family but ``unknown``, and its probability, from ``words``."""
    return score(model, features(rows))


def score(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """The same from ``features``, which go."""
    out = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    rest = F.slice("_p", 2, len(FAMILIES) - 1)
    out = out.withColumn("family_p", F.array_max(rest))
    names = F.array(*[F.lit(f) for f in FAMILIES[1:]])
    return out.withColumn("family", F.element_at(names, F.array_position(rest, F.col("family_p")).cast("int"))).drop("_p", "features", "probability", "rawPrediction", "prediction")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: _id, n_paragraphs, n_licences (confirmed paragraphs), families
    (sorted), evidence (position, family, probability and text of each such paragraph)."""
    rows = described(docs, doc_id, text)
    model, least = learn(rows)
    # a paragraph without a triple of a notice is never confirmed
    claimed = score(model, rows.where("told")).where(F.col("family_p") >= least)
    known = notices(docs.sparkSession).groupBy("family").agg(F.collect_list(triples(F.col("words"))).alias("told"))
    own = triples(F.col("words"))
    like = F.exists("told", lambda t: 100 * F.size(F.array_intersect(own, t)) >= CONFIRM * F.least(F.size(own), F.size(t)))
    sure = claimed.select("_row", "pos", "family", "family_p", "paragraph", "words").join(small(known), "family").where(like)
    sure = sure.groupBy("_row").agg(F.count(F.lit(1)).alias("n_licences"), F.sort_array(F.collect_set("family")).alias("families"),
                                    F.sort_array(F.collect_list(F.struct("pos", "family", "family_p", "paragraph"))).alias("evidence"))
    base = rows.where("coalesce(pos, 0) = 0").select("_row", "_id", "n_paragraphs")
    out = base.join(sure, "_row", "left")
    return out.withColumns({"n_licences": F.coalesce("n_licences", F.lit(0)), "families": F.coalesce("families", F.array().cast("array<string>"))}).drop("_row")
