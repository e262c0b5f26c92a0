"""Licence scan by diagonal voting.

All rolling word k-gram hashes of the texts are joined to the positions of the same hashes in the
templates. Hits are counted by (template, offset diagonal), neighbouring diagonals are merged into
spans, and each span's words are compared with the template's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import content_keys, fold, paired, settle, shielded, text_or_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 4
#: Diagonals up to this many words apart belong to one span, if their hits are at most GAP words apart.
SHIFT, GAP = 3, 24
#: Part of a template's words that a span must have in place.
COVERAGE = 0.8
#: Templates of up to this many words in all are broadcast; larger collections are joined by a shuffle.
BROADCAST_WORDS = 1_000_000

# The phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Words of public licence texts and of the notices that their authors ask for.
TEMPLATES = {
    "gpl-3-line": ("gpl-3", "licensed under the GNU General Public License, version 3"),
    "gpl-notice": (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "mit-line": ("mit", "released under the MIT License"),
    "mit-text": (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2-line": ("apache-2", "licensed under the Apache License, Version 2.0"),
    "apache-2-notice": (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd-text": (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ),
    "isc-text": (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mpl-2-notice": (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "cc-by-nc-line": ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    "cc-by-nc-notice": (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-notice": (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
}


def license_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def with_grams(df: DataFrame, words: Column) -> DataFrame:
    """Adds __words and __g4, the hashes of all grams of GRAM = 4 words."""
    return (
        df.withColumn("__words", words)
        .withColumn("__g1", F.transform("__words", lambda w: F.xxhash64(w)))
        .withColumn("__g2", paired("__g1", "__g1", 1))
        .withColumn("__g4", paired("__g2", "__g2", 2))
        .drop("__g1", "__g2")
    )


def template_table(spark: SparkSession, templates: dict[str, tuple[str, str]]) -> DataFrame:
    """(template, label, words, grams) of the templates; one of fewer than GRAM words cannot be found
    by its grams and raises."""
    short = [name for name, (_, text) in templates.items() if len([w for w in re.split(SEPARATORS, text) if w]) < GRAM]
    if short:
        raise ValueError(f"templates of fewer than {GRAM} words: {', '.join(sorted(short))}")
    rows = [(name, label, text) for name, (label, text) in templates.items()]
    table = with_grams(spark.createDataFrame(rows, "template string, label string, text string"), license_words(F.col("text")))
    return table.select("template", "label", F.col("__words").alias("tw"), F.col("__g4").alias("tg"))


def spans(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, *, coverage: float = COVERAGE) -> DataFrame:
    """(__t1, __t2, template, label, first_word, end_word, covered) of every verified span, by the
    content keys of the text. covered is the part of the template's words that stand in place.

    The templates' positions (some hundred rows) are broadcast while they are few. Only hits leave
    the join; they are counted within tasks before they are shuffled, and copies of a text are
    counted once. Diagonals follow each other at most SHIFT apart; along such a band, hits that begin
    beyond GAP words after all before them start a new span.
    """
    table = template_table(docs.sparkSession, templates)
    at = table.select("template", F.posexplode("tg").alias("__tpos", "__tgram"))
    t1, t2 = content_keys(text_or_empty())
    texts = docs.select(text_or_empty().alias("__text"), t1.alias("__t1"), t2.alias("__t2"))
    # outer: Spark would else filter on the array's size before it, and build the array once more for that
    grams = with_grams(texts, license_words(F.col("__text"))).select("__t1", "__t2", F.posexplode_outer("__g4").alias("__pos", "__gram"))
    few = F.broadcast if sum(len(text) for _, text in templates.values()) <= BROADCAST_WORDS else (lambda df: df)
    hits = grams.join(few(at), F.col("__gram") == F.col("__tgram"))
    votes = (
        hits.select("__t1", "__t2", "template", (F.col("__pos") - F.col("__tpos")).alias("diagonal"), "__pos")
        .distinct()
        .groupBy("__t1", "__t2", "template", "diagonal")
        .agg(F.count("*").alias("votes"), F.min("__pos").alias("lo"), F.max("__pos").alias("hi"))
    )
    own = ["__t1", "__t2", "template"]
    across = Window.partitionBy(*own).orderBy("diagonal")
    along = Window.partitionBy(*own, "__band").orderBy("lo", "diagonal")
    reach = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(across) > SHIFT, F.lit(True))
    merged = (
        votes.withColumn("__far", far.cast("int"))
        .withColumn("__band", F.sum("__far").over(across))
        .withColumn("__new", F.coalesce(F.col("lo") - reach > GRAM + GAP, F.lit(True)).cast("int"))
        .withColumn("__span", F.sum("__new").over(along))
        .groupBy(*own, "__band", "__span")
        .agg(F.min("lo").alias("first_word"), (F.max("hi") + GRAM).alias("end_word"), F.sort_array(F.collect_set("diagonal")).alias("diagonals"))
    )
    found = settle(merged)
    wanted = found.select("__t1", "__t2").distinct()
    whole = texts.join(wanted, ["__t1", "__t2"], "left_semi").dropDuplicates(["__t1", "__t2"])
    whole = whole.select("__t1", "__t2", license_words(F.col("__text")).alias("__words"))
    checked = found.join(whole, ["__t1", "__t2"]).join(few(table.drop("tg")), "template")
    in_place = F.expr("size(filter(sequence(0, size(tw) - 1), j -> exists(diagonals, d -> get(__words, j + d) <=> tw[j])))")
    return (
        checked.withColumn("covered", in_place / F.size("tw"))
        .where(F.col("covered") >= coverage)
        .select("__t1", "__t2", "template", "label", "first_word", "end_word", "covered")
    )


def phrase_places(joined: Column, phrase: str) -> Column:
    """Word positions at which the phrase stands. `joined` holds the words, each with a blank before
    and after it; what is left between two places tells how many words lie there."""
    n = len(phrase.split())
    parts = F.split(joined, f" {phrase}(?= )")
    words_in = lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))
    step = lambda at, p: (at + words_in(p) + n, F.array(at + words_in(p)))
    found = fold(F.slice(parts, F.lit(1), F.size(parts) - 1), "array<int>", F.lit(0), step)
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


@shielded
def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, *, coverage: float = COVERAGE) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score and
    license_spans added.

    Base: each place where a phrase's words stand consecutively. The template spans of `spans` add
    labels; score is the best covered part of a template, or 1 with a phrase. license_spans holds
    (template, first_word, end_word, covered) in order. Templates that cover a place equally well each
    add their label.

    Nulls: a null text is empty, doc_id is not looked at; repeated rows get equal results; an empty
    table gives an empty one. Input columns named like an added one are replaced, others carried.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans"]
    docs = docs.drop(*added)
    own = docs.columns
    span = F.struct("template", "first_word", "end_word", "covered")
    found = (
        spans(docs, templates, coverage=coverage)
        .groupBy("__t1", "__t2")
        .agg(F.collect_set("label").alias("__more"), F.max("covered").alias("__best"), F.array_sort(F.collect_list(span)).alias("license_spans"))
        .withColumnsRenamed({"__t1": "__m1", "__t2": "__m2"})
    )
    t1, t2 = content_keys(text_or_empty())
    rows = docs.select("*", license_words(text_or_empty()).alias("__words"), t1.alias("__t1"), t2.alias("__t2"))
    rows = rows.select(*own, "__t1", "__t2", F.size("__words").cast("long").alias("n_words"), F.array_join("__words", " ").alias("__joined"))
    rows = rows.withColumn("__joined", F.concat(F.lit(" "), F.col("__joined"), F.lit(" ")))
    for i, phrase in enumerate(PHRASES):
        rows = rows.withColumn(f"__p{i}", phrase_places(F.col("__joined"), phrase))
    rows = rows.drop("__joined")
    places = F.concat(*(F.col(f"__p{i}") for i in range(len(PHRASES))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"__p{i}") > 0, label) for i, label in enumerate(PHRASES.values()))))
    rows = rows.withColumn("__places", places).withColumn("__labels", labels)
    joined = rows.join(found, (F.col("__t1") == F.col("__m1")) & (F.col("__t2") == F.col("__m2")), "left")
    every = F.array_union("__labels", F.coalesce("__more", F.array().cast("array<string>")))
    return joined.select(
        *own,
        "n_words",
        F.size("__places").cast("long").alias("n_base"),
        F.array_min("__places").cast("long").alias("first_word"),
        F.array_max("__places").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("__labels")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(every)), ",").alias("labels"),
        F.when(F.size("__places") > 0, F.lit(1.0)).otherwise(F.coalesce("__best", F.lit(0.0))).alias("score"),
        "license_spans",
    )
