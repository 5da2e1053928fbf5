"""Licence scans: a trained paragraph classifier, confirmed against templates.

Word unigrams and bigrams of a paragraph feed a multinomial logistic
regression over licence families and "none", trained on templates in varied
surroundings. A prediction below the calibrated probability is "unknown"; one
that no template of its family bears out is unconfirmed. Every piece of every
paragraph is classified. DataFrame functions and Spark's own models only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .spans import let

#: Family -> sentences of its notices and texts.
TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "released under the apache 2 0 license",
        "spdx license identifier apache 2 0",
        "apache 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
        "licensed to the apache software foundation asf under one or more contributor license agreements see the notice file distributed with this work for additional information regarding copyright ownership",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "this project is licensed under the terms of the mit license",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software",
        "mit licensed see the license file",
        "spdx license identifier mit",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "licensed under the bsd 3 clause license",
        "this software is released under the 2 clause bsd license",
        "use of this source code is governed by a bsd style license",
        "spdx license identifier bsd 3 clause",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu gpl version 2 or later",
        "you should have received a copy of the gnu general public license along with this program",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "released under the gpl version 3",
        "spdx license identifier gpl 3 0 or later",
        "gplv3 or later",
        "gplv2 or later",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2 1",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "spdx license identifier lgpl 2 1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "released under the lgpl version 3",
    ],
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "spdx license identifier agpl 3 0",
        "you should have received a copy of the gnu affero general public license along with this program",
        "released under the agpl version 3",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
        "spdx license identifier mpl 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "released under the mpl 2 0",
    ],
    "cc": [
        "licensed under cc by nc 4 0",
        "licensed under cc by sa 4 0",
        "cc by sa 4 0",
        "cc by nc 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        "released under the creative commons cc0 public domain dedication",
        "content is available under a creative commons attribution sharealike license",
        "this article is distributed under the terms of the creative commons attribution license which permits unrestricted use distribution and reproduction in any medium provided the original work is properly cited",
        "to view a copy of this license visit http creativecommons org licenses by 4 0",
        "shared under cc by 4 0",
        "cc by nc sa 4 0 international",
    ],
    "proprietary": [
        "all rights reserved no part of this publication may be reproduced or transmitted in any form without prior written permission",
        "copyright all rights reserved",
        "all rights reserved",
        "c 2020 by the authors all rights reserved worldwide",
        "this software is proprietary and confidential unauthorized copying is strictly prohibited",
        "no part of this document may be copied or distributed without the prior written permission of the owner all rights reserved",
        "the information contained herein is the property of the company and may not be disclosed",
    ],
    "none": [
        "the driver must show a valid driving license at the counter",
        "poetic license lets the author bend the facts",
        "the city licenses taxis and restaurants every year",
        "permission to enter the building is given by the guard",
        "the warranty covers parts and labour for two years",
        "he was under the impression that the version was released",
        "the university released a general report on public health",
        "copyright law is taught in the second year",
        "the terms of the contract were met with modification",
        "the fishing licence costs ten pounds a year",
        "the minister gave permission to release the report under the new law",
        "she lost her driving licence for two years and sold the car",
        "the software is used as is by most of the schools in the city",
        "a warranty of two years comes with every machine that they sell",
        "the apache helicopter landed near the general hospital",
        "the gnu is a large animal of the african plains",
        "the copyright office opens at nine and closes at five",
        "public libraries lend books to everyone free of charge",
        "under the terms of the treaty both sides withdrew",
        "the contract may be copied and sent to the other party",
    ],
}
#: Family -> names of its licences; with each way of saying so they make further labelled notices.
NAMES = {
    "apache": ["the apache license version 2 0", "the apache 2 0 license", "the apache software license"], "mit": ["the mit license", "mit", "an mit style license"],
    "bsd": ["the bsd license", "the 3 clause bsd license", "a bsd style license", "the new bsd license"], "gpl": ["the gnu general public license version 3", "the gnu gpl version 2 or later", "the gnu general public license version 2", "gplv3"],
    "lgpl": ["the gnu lesser general public license version 2 1", "the gnu lgpl"], "agpl": ["the gnu affero general public license version 3", "the gnu agpl"],
    "mpl": ["the mozilla public license version 2 0", "the mpl 2 0"], "cc": ["cc by sa 4 0", "cc by nc 4 0", "cc by 4 0", "a creative commons attribution 4 0 license", "a creative commons license", "cc0"],
    "proprietary": ["all rights reserved", "copyright 2020 the authors all rights reserved", "copyright c the company all rights reserved", "a proprietary license all rights reserved", "the exclusive rights of the owner all rights reserved"],
}
WAYS = ["distributed under the terms of", "made available under", "covered by", "this file is under", "published under", "free software under", "use is subject to"]
FAMILIES = list(TEMPLATES)
#: Templates that confirm but never train, so that the classifier can be measured on them.
HELD_OUT = [
    "released under the mit license", "licensed under the apache license version 2 0", "this work is licensed under the gnu general public license version 3", "licensed under cc by nc 4 0",
    "copyright all rights reserved", "licensed under the bsd 3 clause license", "licensed under the gnu lesser general public license version 2 1", "licensed under the gnu affero general public license version 3", "licensed under the mozilla public license version 2 0",
]
_FOUND = "line:int,family:string,probability:double,confirmed:boolean"
#: Words of prose in four languages, some of which licences share: lines of them, in any order, train as "none".
PROSE = (
    "the of and to in is that it was for on are as with his they at be this have from or had by not but some what there we can out other were all your when up use how said each she which their time if will way about many then them would like so these her long make thing see him two has look more day could go come did no most who over know than call first may down side been now find any new work part take get place made where after back little only as is was it as is"
    " mit der die das und ist nicht ein eine er sie es von zu den dem des im in auf für ohne mit auch nach wie war sich aus bei am hat wird noch nur so oder mit und der mit dem haus kam ging zeit rat"
    " le la les de du des et est un une que qui dans pour pas sur au avec ce il elle sont plus par on ne se as de coeur à tout mais"
    " el los las y en que se del por con una para es al lo como más pero sus este ya o así casa todo queda"
).split()
#: Lines of them that train, and words that a line has at most.
PROSE_LINES, PROSE_WORDS = 1200, 24
#: Words of a piece of a line; pieces of the paragraph before and after that are read with it.
PIECE, AROUND = 24, 4
#: Copies of each template that train and that calibrate.
COPIES, HELD = 8, 4
#: Part of the held copies of known families that may fall to "unknown".
MISSED = 0.02
#: Part of some template's bigrams that a confirmed paragraph holds, and how many of them its piece must have, with the words that stand next to it.
CONFIRMED, OWN = 0.6, 2


def grams(paragraph: Column) -> Column:
    """Distinct word unigrams and bigrams."""
    return F.array_distinct(all_grams(paragraph))


def all_grams(paragraph: Column) -> Column:
    """Word unigrams and bigrams, repeats too; texts that begin or end otherwise have an empty word there, which no vocabulary holds."""
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    both = lambda w: F.when(F.size(w) > 1, F.concat(w, pairs(w))).otherwise(w)
    return let(words_of(paragraph), both)


def words_of(paragraph: Column) -> Column:
    return F.split(F.lower(paragraph), "[^a-z0-9]+")


def telling_words(templates: list[list[str]]) -> list[str]:
    """Words, seldom ones first, of which a text that holds CONFIRMED of a template's bigrams has at least one."""
    left = [(t, len(t)) for t in templates]
    chosen: list[str] = []
    while left := [([g for g in t if not set(g.split()) & set(chosen)], n) for t, n in left]:
        left = [(t, n) for t, n in left if len(t) >= CONFIRMED * n]
        if left:
            words = [w for t, _ in left for g in t for w in g.split()]
            chosen.append(max(sorted(set(words)), key=lambda w: (w not in PROSE, len(w) > 2, words.count(w))))
    return chosen


@dataclass(frozen=True)
class Classifier:
    features: CountVectorizerModel  # of grams that trained; others don't count
    families: LogisticRegressionModel
    threshold: float


def labelled_paragraphs(spark: SparkSession) -> DataFrame:
    """(family, copy, paragraph): templates but those of HELD_OUT, and the NAMES said in different WAYS, with other words before and after and some left out.

    Every other copy of a template longer than a piece is a stretch of it as long as a piece.
    """
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts if t not in HELD_OUT]
    rows += [(f, f"{way} {name}") for f, names in NAMES.items() for name in names for way in WAYS]
    df = spark.createDataFrame(rows, "family string, t string").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES + HELD - 1))))
    draw = lambda what, n: F.pmod(F.xxhash64("t", "copy", *([F.lit(what)] if isinstance(what, str) else what)), F.lit(n))
    filler = F.split(F.lit("this the file project in for and code of work a text data see notes le la der die el que page here by is"), " ")
    some = lambda side: F.array_join(F.transform(F.sequence(F.lit(1), (draw(side, 8) + 1).cast("int")), lambda i: F.element_at(filler, (draw([i, F.lit(side)], 24) + 1).cast("int"))), " ")
    words = F.split("t", " ")
    start = F.when(F.col("copy") % 2 == 1, F.pmod(F.xxhash64("t", "copy"), F.greatest(F.size(words) - PIECE + 1, F.lit(1)))).otherwise(0).cast("int")
    stretch = F.when(F.col("copy") % 2 == 1, F.slice(words, start + 1, F.lit(PIECE))).otherwise(words)
    kept = F.array_join(F.filter(stretch, lambda w, i: (F.col("copy") % 4 < 2) | (draw([w, i], 12) > 0)), " ")
    whole = F.when(F.col("copy") == 0, F.col("t")).otherwise(F.concat_ws(" ", some("before"), kept, some("after")))
    prose = F.array(*map(F.lit, PROSE))
    size = (F.pmod(F.xxhash64("id"), F.lit(PROSE_WORDS)) + 1).cast("int")
    line = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.get(prose, F.pmod(F.xxhash64("id", i), F.lit(len(PROSE))).cast("int"))), " ")
    lines = spark.range(PROSE_LINES).withColumns({"family": F.lit("none"), "copy": F.lit(0), "paragraph": line})
    return df.select("family", "copy", whole.alias("paragraph")).unionByName(lines.select("family", "copy", "paragraph"))


def train_classifier(labelled: DataFrame, missed: float = MISSED) -> Classifier:
    """Fit on the first COPIES copies; calibrate "unknown" on the others.

    ``labelled`` is a bounded sample: its rows are the templates' copies and lines of prose.
    """
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1
    rows = labelled.select("family", "copy", F.array_remove(grams(F.regexp_replace(F.lower("paragraph"), "^[^a-z0-9]+|[^a-z0-9]+$", "")), "").alias("grams"), label.cast("double").alias("label")).coalesce(1)
    features = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(rows.filter(F.col("copy") < COPIES))
    rows = features.transform(rows)
    families = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=60).fit(rows.filter(F.col("copy") < COPIES))
    held = families.transform(rows.filter((F.col("copy") >= COPIES) & (F.col("family") != "none")))
    p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    return Classifier(features, families, min(0.9, float(held.agg(F.percentile(p, F.lit(missed))).first()[0])))


def classify_paragraphs(docs: DataFrame, model: Classifier, *, text_col: str = "text", out_col: str = "paragraphs", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with an array of structs: line (from 0), family, probability, confirmed.

    Paragraphs end at blank lines. All their lines, long ones in pieces, are
    classified alone; joined with the pieces around them, so that wrapped
    notices are whole, where the piece alone is unknown or where the joined
    text bears out some family, as elsewhere it can't change the result.
    Neighbouring pieces of one family are one notice, at the line of the first. ``none`` is left out; ``unknown`` is a licence-like
    piece of which the model isn't sure. confirmed: the joined text holds
    CONFIRMED of the bigrams of a template of the family, and the piece OWN of
    them. Null and empty texts have none. Whole texts are read; repeated rows
    give the same each. Pieces are rows; notices, and the columns of each row,
    are shuffled once to bring a row's notices together. Columns pass through,
    or those in ``keep``; one named ``out_col`` is replaced.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "\0", " ")
    families = F.array(*map(F.lit, FAMILIES))
    pairs = lambda t: list(dict.fromkeys(" ".join(w) for w in zip(t.split(), t.split()[1:], strict=False)))
    templates = [(f, pairs(t)) for f, ts in TEMPLATES.items() for t in ts if f != "none"]
    known = F.array(*(F.struct(F.lit(f).alias("f"), F.array(*map(F.lit, g)).alias("g")) for f, g in templates))
    every = F.array(*map(F.lit, dict.fromkeys(x for _, g in templates for x in g)))
    holds = lambda t, near: F.size(F.array_intersect(t["g"], near)) >= CONFIRMED * F.size(t["g"])
    kept = [c for c in docs.columns if c != out_col and (keep is None or c in keep)]
    row, x, alone, joined, borne = fresh(docs, "row", "x", "alone", "joined", "borne")

    def pieces_of(line: Column, number: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
        blank = F.array(F.struct(number.alias("line"), F.lit("\0").alias("text")))
        cut = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / PIECE).cast("int")), lambda j: F.struct(number.alias("line"), F.array_join(F.slice(w, j * PIECE + 1, PIECE), " ").alias("text"))))
        return F.when(line.rlike(r"\S"), cut).otherwise(blank)

    def surrounded(pieces: Column, texts: Column, may: Column) -> Column:
        place = lambda k: F.greatest(k - AROUND, F.lit(0))
        # what a blank line cuts off isn't of the paragraph
        before = lambda k: F.substring_index(F.array_join(F.slice(texts, place(k) + 1, k - place(k)), "\n"), "\0", -1)
        after = lambda k: F.substring_index(F.array_join(F.slice(texts, k + 2, F.lit(AROUND)), "\n"), "\0", 1)
        one = lambda p, k: F.struct(k.alias("k"), p["line"].alias("line"), p["text"].alias("text"), before(k).alias("before"), after(k).alias("after"), may.alias("may"), F.lit(None).cast(docs.select(F.struct(*kept) if kept else F.struct(F.lit(0).alias("_"))).schema[0].dataType).alias("of"))
        return F.filter(F.transform(pieces, one), lambda p: p["text"] != "\0")

    pieces = F.flatten(F.transform(F.split(text, "\n"), pieces_of))
    telling = F.array(*map(F.lit, telling_words([g for _, g in templates])))
    holding = lambda g: (F.size(g) >= OWN) & F.exists(known, lambda t: holds(t, g))
    may = F.when(F.arrays_overlap(words_of(text), telling), let(F.array_intersect(every, all_grams(text)), holding)).otherwise(False)
    around = let(pieces, lambda p: let(F.transform(p, lambda q: q["text"]), lambda texts: let(may, lambda m: surrounded(p, texts, m))))
    # each row's columns stand once, before its pieces
    head = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).alias("line"), F.lit("").alias("text"), F.lit("").alias("before"), F.lit("").alias("after"), F.lit(False).alias("may"), (F.struct(*kept) if kept else F.struct(F.lit(0).alias("_"))).alias("of")))
    rows = docs.withColumn(row, F.monotonically_increasing_id()).select(row, F.explode(F.concat(head, around)).alias(x))

    def judged(df: DataFrame, words: Column, out: str) -> DataFrame:
        """``df`` with the family of ``words`` and its probability."""
        g, v, p = fresh(df, "g", "v", "p")
        df = model.features.copy({model.features.inputCol: g, model.features.outputCol: v}).transform(df.withColumn(g, words))
        m = model.families
        df = m.copy({m.featuresCol: v, m.probabilityCol: p, m.rawPredictionCol: "", m.predictionCol: ""}).transform(df)
        best = let(vector_to_array(p), lambda a: let(F.array_max(a), lambda b: F.struct(F.element_at(families, F.array_position(a, b).cast("int")).alias("f"), b.alias("p"))))
        return df.withColumn(out, best).drop(g, v, p)

    def only(df: DataFrame, condition: Column) -> DataFrame:
        """Rows that meet the condition. Spark would push a filter below the models, which would judge each row once more for every mention of their results."""
        one = fresh(df, "one")[0]
        return df.select(F.explode(F.when(condition, F.array(F.struct(*df.columns)))).alias(one)).select(f"{one}.*")

    unknown = lambda v: (v["f"] != "none") & (v["p"] < model.threshold)
    rows = judged(rows, all_grams(F.col(x)["text"]), alone)
    near = F.concat_ws("\n", F.col(x)["before"], F.col(x)["text"], F.col(x)["after"])
    own = F.concat_ws(" ", F.regexp_extract(F.col(x)["before"], r"([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1), F.col(x)["text"], F.regexp_extract(F.col(x)["after"], "[A-Za-z0-9]+", 0))
    shared = lambda words: F.array_intersect(every, all_grams(words))
    none = F.array().cast("array<string>")
    borne_by = lambda o, n: F.transform(F.filter(known, lambda t: (F.size(F.array_intersect(t["g"], o)) >= OWN) & holds(t, n)), lambda t: t["f"])
    bearing = let(shared(own), lambda o: F.when(F.size(o) >= OWN, let(shared(near), lambda n: borne_by(o, n))).otherwise(none))
    rows = rows.withColumn(borne, F.when(F.col(x)["may"], bearing).otherwise(none))
    asked = (F.col(x)["k"] >= 0) & (unknown(F.col(alone)) | (F.size(borne) > 0))
    rows = only(rows, (F.col(x)["k"] < 0) | (F.col(alone)["f"] != "none") | (F.size(borne) > 0))
    rows = judged(rows, F.when(asked, all_grams(near)).otherwise(none), joined)

    def verdict(v: Column) -> Column:
        return F.struct(F.when(unknown(v), "unknown").otherwise(v["f"]).alias("family"), v["p"].alias("probability"), ((v["f"] != "none") & ~unknown(v) & F.array_contains(borne, v["f"])).alias("confirmed"))

    def chosen(a: Column, b: Column) -> Column:
        better = asked & ((b["confirmed"] & ~a["confirmed"]) | ((a["family"] == "unknown") & ~b["family"].isin("unknown", "none")))
        return F.when(better, b).otherwise(a)

    found = let(chosen(verdict(F.col(alone)), verdict(F.col(joined))), lambda v: F.struct(F.col(x)["k"].alias("k"), F.col(x)["line"].alias("line"), v["family"].alias("family"), v["probability"].alias("probability"), v["confirmed"].alias("confirmed")))
    rows = rows.select(row, F.col(x)["of"].alias("of"), F.when(F.col(x)["k"] >= 0, found).alias("found"))
    rows = only(rows, F.expr("found is null or found.family <> 'none'"))

    def merged(out: Column, p: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        one = F.struct(p["k"].alias("k"), last["line"].alias("line"), p["family"].alias("family"), F.greatest(last["probability"], p["probability"]).alias("probability"), (last["confirmed"] | p["confirmed"]).alias("confirmed"))
        same = (F.size(out) > 0) & (last["k"] == p["k"] - 1) & (last["family"] == p["family"])
        return F.when(same, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(out, F.array(p)))

    all_of = rows.groupBy(row).agg(F.first("of", ignorenulls=True).alias("of"), F.array_sort(F.collect_list("found")).alias("found"))
    notices = F.transform(F.aggregate("found", F.array().cast(f"array<struct<k:int,{_FOUND}>>"), merged), lambda p: p.dropFields("k"))
    return all_of.select(*(F.col("of")[c].alias(c) for c in kept), notices.cast(f"array<struct<{_FOUND}>>").alias(out_col))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its notices, how many are confirmed or unknown, and the confirmed families. Null and empty texts have none; repeated rows and ids count one by one; see ``classify_paragraphs``."""
    found = classify_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"), train_classifier(labelled_paragraphs(spark)), keep=["doc_id"])
    confirmed = F.filter("paragraphs", lambda p: p["confirmed"])
    names = F.array_sort(F.array_distinct(F.transform(confirmed, lambda p: p["family"])))
    count = lambda x: F.size(x).cast("long")
    return found.select(
        "doc_id", count("paragraphs").alias("n_notices"), count(confirmed).alias("n_confirmed"),
        count(F.filter("paragraphs", lambda p: p["family"] == "unknown")).alias("n_unknown"), F.array_join(names, ",").alias("families"),
        F.array_join(F.transform("paragraphs", lambda p: F.concat_ws(":", p["line"].cast("string"), p["family"])), ",").alias("notices"),
    )
