"""Licence scan by rare words and their places.

Templates are whole licence wordings, notices, and the short lines by which texts name their licence. Every text gives
the words that stand in templates, with their places. Document frequencies of these words over all texts tell which of a
template's words in the text are rarest; these are looked up for each template, so that other notices and prose take no
place from it, and the difference between the place in the text and the place in the template is counted: a licence that
really stands there gives one difference again and again. A template so aligned counts only if its mandatory key phrase
stands in the text.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm.session import documents, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that are a label wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Fixed values: (label, mandatory key phrase, wording). Short notices by which texts name their licence.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license"),
    ("agpl", "affero general public license", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0", "dedicated to the public domain under cc0 1 0 universal"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
]
# Fixed values: (label, mandatory key phrase, wording). Whole licences and notices, as words.
WORDINGS = [
    (
        "mit",
        "permission is hereby granted",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties "
        "of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "isc",
        "permission to use copy modify",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action",
    ),
    (
        "zlib",
        "altered source versions",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to "
        "the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must "
        "be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    ),
    (
        "apache",
        "apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http "
        "www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without "
        "even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "mpl",
        "mozilla public license",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
        "https mozilla org mpl 2 0",
    ),
    (
        "unlicense",
        "unencumbered software",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
        "source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
]
TEMPLATES += WORDINGS
#: Words too common in any text to look up; so is a word of fewer letters, but for those of short lines.
COMMON = "a an and any are be by can for free in is it made of or source the this to use used with without you work person forms terms under files copy version charge fee purpose".split()
LETTERS = 6
#: Words of each template that are looked up in a text; a template's weight is that of twice as many.
RAREST = 6
#: The least share of a template's weight that must be aligned.
ALIGNED = 0.6


def looked_up(template: tuple[str, str, str]) -> list[tuple[str, int]]:
    """A template's words that are looked up, each with its places."""
    long = template in WORDINGS
    return [(w, at) for at, w in enumerate(template[2].split()) if w not in COMMON and not w.isdigit() and (not long or len(w) >= LETTERS)]


def vocabulary() -> list[str]:
    return sorted({w for t in TEMPLATES for w, _ in looked_up(t)} | {w for p in PHRASES for w in p.split()})


def starts(places: dict[str, Column], phrase: str) -> Column:
    """Where the words of a phrase stand one after the other."""
    words = phrase.split()
    return reduce(F.array_intersect, [F.transform(places[w], partial(earlier, k)) for k, w in enumerate(words)])


def earlier(k: int, x: Column) -> Column:
    return x - k


def is_word(w: str, x: Column) -> Column:
    return x["word"] == w


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. n_base counts the places of base
    phrases, first_word and last_word are the smallest and largest start (null without any), base_labels their labels,
    labels also those of aligned templates, both sorted and joined by commas. score is the largest share of a template's
    weight that is aligned, verified by its key phrase; it is 0 for a text with no aligned word. Null texts are empty;
    doc_id may be null or repeat, and so may rows. Other columns are ignored. An empty table has no rows.
    """
    lower = F.translate("text", UPPER, UPPER.lower())
    words = F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(WORD), F.lit(0))
    plain = documents(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    known = vocabulary()
    marked = F.filter(F.transform("words", lambda w, i: F.when(w.isin(known), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    hits = plain.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), marked.alias("hits"), "words")
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    phrases = sorted({k for _, k, _ in TEMPLATES})
    held = F.when(F.size("hits") > 1, F.filter(F.array(*[F.when(joined.contains(f" {k} "), F.lit(k)) for k in phrases]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    seen = stored(hits.select("row", "doc_id", "n_words", "hits", held.alias("held")), "licence_words")

    needed = sorted({w for p in PHRASES for w in p.split()})
    places = {w: F.transform(F.filter("hits", partial(is_word, w)), lambda x: x["at"]) for w in needed}
    found = {p: starts(places, p) for p in PHRASES}
    base = F.when(F.size("hits") > 1, F.concat(*found.values())).otherwise(F.array().cast("array<int>"))
    base_labels = F.filter(F.array(*[F.when((F.size("hits") > 1) & (F.size(a) > 0), F.lit(PHRASES[p])) for p, a in found.items()]), lambda x: x.isNotNull())

    spark = docs.sparkSession
    # document frequencies over all texts; a bounded table, one row for each word of the templates
    frequency = seen.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = seen.agg(F.count("*").alias("total"))
    idf = stored(frequency.crossJoin(F.broadcast(total)).select("word", F.log((1 + F.col("total")) / F.col("df")).alias("idf")), "idf")
    rows = [(t, x[0], x[1], w, at) for t, x in enumerate(TEMPLATES) for w, at in looked_up(x)]
    postings = spark.createDataFrame(rows, "template int, label string, key string, word string, place int")
    # a word that no text has is rarer than all others, and never aligned
    postings = postings.join(F.broadcast(idf), "word", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("idf"), "word", "place"))
    weight = postings.withColumn("rank", rank).where(F.col("rank") <= 2 * RAREST).groupBy("template").agg(F.sum("idf").alias("weight"))
    postings = stored(postings.join(F.broadcast(weight), "template"), "postings")

    # only templates whose key phrase stands in the text are aligned, each by the rarest of its own words found there
    placed = seen.where((F.size("hits") > 1) & (F.size("held") > 0)).select("row", "held", F.explode("hits").alias("hit")).select("row", "held", "hit.word", "hit.at")
    own = postings.groupBy("word", "template", "key").agg(F.first("idf").alias("idf"), F.count("*").alias("times"))
    owned = placed.select("row", "held", "word").distinct().join(F.broadcast(own), "word").where(F.array_contains("held", F.col("key"))).groupBy("row", "template")
    rare = owned.agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("order"), "word", "times"))), 1, RAREST).alias("rare"))
    rare = rare.select("row", "template", F.col("rare.word").alias("rare"), F.aggregate("rare", F.lit(0.0), lambda x, r: x - r["order"] * r["times"]).alias("possible"))
    aligned = placed.join(F.broadcast(postings), "word").where(F.array_contains("held", F.col("key"))).join(rare, ["row", "template"])
    aligned = aligned.where(F.array_contains("rare", F.col("word")))
    votes = aligned.groupBy("row", "template", "label", "weight", "possible", (F.col("at") - F.col("place")).alias("shift")).agg(F.sum("idf").alias("vote"))
    scored = votes.select("row", "label", F.least(F.lit(1.0), F.col("vote") / F.greatest("possible", F.col("weight") * 0.5)).alias("share"))
    best = scored.groupBy("row").agg(F.max("share").alias("score"), F.collect_set(F.when(F.col("share") >= ALIGNED, F.col("label"))).alias("more"))
    empty = F.array().cast("array<string>")
    return seen.join(best, "row", "left").select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("more", empty))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
