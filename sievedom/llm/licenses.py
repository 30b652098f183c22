"""License scans by diagonal voting over word k-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import with_row_id

#: Letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    words: str
    label: str
    base: bool = False


MIT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including
without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty
of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders
be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
"""
BSD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above
copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in
the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but
not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and
on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
damage
"""
ISC = """
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all
copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author
be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
action arising out of or in connection with the use or performance of this software
"""
APACHE = """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses
license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either
express or implied see the license for the specific language governing permissions and limitations under the license
"""
GPL = """
this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license
or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
particular purpose see the gnu general public license for more details
"""
#: Phrases that count as such (base), then notices and whole licence texts that the method finds with gaps and changes.
TEMPLATES = (
    Template("cc by", "cc-by", True),
    Template("general public license", "gpl", True),
    Template("all rights reserved", "reserved", True),
    Template("released under the mit license", "mit"),
    Template("licensed under the apache license version 2 0", "apache-2.0"),
    Template("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    Template("gnu lesser general public license", "lgpl"),
    Template("this work is licensed under a creative commons attribution", "cc-by"),
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    Template("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    Template("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    Template("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    *(Template(" ".join(text.split()), label) for text, label in ((MIT, "mit"), (BSD, "bsd"), (ISC, "isc"), (APACHE, "apache-2.0"), (GPL, "gpl-3.0"))),
)
#: Diagonals this near each other are one occurrence with words put in or left out.
GAP = 2
#: Share of a template's k-grams that an occurrence needs, and how many times the template's words it may span.
NEEDED, SPAN = 0.75, 1.5
#: Templates of so many words or more are found by k-grams of LONG_K words, as two words of a long text are in every other text.
LONG_WORDS, LONG_K = 24, 4


def scan_licenses(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, *, k: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs`` with the licence phrases in it.

    Every ``k`` words in a row (LONG_K for templates of LONG_WORDS words or more,
    of any length) are hashed and joined to the templates' k-grams, words compared,
    too; places whose hash no template has are left out before they become rows.
    A hit votes for the diagonal word place minus template place.  Diagonals of
    one template at most GAP apart are merged, and an occurrence is verified: a
    base phrase needs all its k-grams on one diagonal, so its words stand
    consecutively; another template needs NEEDED of its k-grams between the
    first and the last word of the text that is part of it, which are at most
    SPAN times as many words as it has.  Merged diagonals that span more are
    tried one by one.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and spans (text: label:first word:end word, exclusive).  A null or
    empty text has no words, labels '' and score 0; rows that repeat are scanned
    each for itself; an empty table gives no rows; other columns are not read,
    whatever their names.
    """
    spark = docs.sparkSession
    grams, about = [], []
    for no, t in enumerate(templates):
        words = t.words.split(" ")
        g = LONG_K if len(words) >= LONG_WORDS and not t.base else k
        about.append((no, t.label, t.base, len(words), len(words) - g + 1, g))
        grams += [(g, " ".join(words[at : at + g]), no, at) for at in range(len(words) - g + 1)]
    sizes = sorted({g for g, *_ in grams})
    # the templates are a constant of the call: some hundred rows
    index = spark.createDataFrame(grams, "g int, gram string, tpl int, tpos int").withColumn("gh", F.xxhash64("gram"))
    known = {g: [] for g in sizes}
    for r in index.select("g", "gh").distinct().collect():
        known[r.g].append(r.gh)
    about = spark.createDataFrame(about, "tpl int, label string, base boolean, n_tpl int, n_grams int, g int")
    base = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), "row_id")
    # lower() differs from lower-casing A-Z in letters beyond ASCII, which are word characters either way
    base = base.select("doc_id", "row_id", F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w")

    most, names = max(sizes), [f"w{i}" for i in range(max(sizes))]
    shifted = [F.slice("w", i + 1, F.greatest(n, F.lit(1))).alias(f"w{i}") for i in range(most)]
    zipped = F.arrays_zip(*shifted, F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")).alias("pos"))
    rows = base.select("doc_id", "row_id", n.cast("long").alias("n_words"), F.inline_outer(zipped)).toDF("doc_id", "row_id", "n_words", *names, "pos")
    # a look at the first word spares most places the hashes; a text's first place stays as its row
    starts = {g: sorted({x.split(" ")[0] for h, x, *_ in grams if h == g}) for g in sizes}
    begins = F.col("w0").isin(*sorted(set().union(*starts.values())))
    rows = rows.where(F.coalesce(begins, F.lit(False)) | (F.coalesce("pos", F.lit(0)) == 0))
    gram = {g: F.concat_ws(" ", *names[:g]) for g in sizes}
    there = {g: F.col(names[g - 1]).isNotNull() & F.col("w0").isin(*starts[g]) & F.xxhash64(gram[g]).isin(*known[g]) for g in sizes}
    found = [F.when(F.coalesce(there[g], F.lit(False)), F.struct(F.lit(g).alias("g"), gram[g].alias("gram"))) for g in sizes]
    first = F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct(F.lit(0).alias("g"), F.lit("").alias("gram")))
    rows = rows.select("doc_id", "row_id", "n_words", "pos", F.explode(F.array_compact(F.array(first, *found))).alias("x")).select("doc_id", "row_id", "n_words", "pos", "x.g", "x.gram")
    near = F.broadcast(index.withColumnRenamed("g", "tg").withColumnRenamed("gram", "tgram"))
    hits = rows.join(near, (F.xxhash64("gram") == F.col("gh")) & (F.col("g") == F.col("tg")) & (F.col("gram") == F.col("tgram")), "left")
    votes = hits.groupBy("row_id", "doc_id", "n_words", "tpl", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.collect_set("tpos").alias("at"))
    along = W.partitionBy("row_id", "tpl").orderBy("diag")
    runs = votes.withColumn("run", F.sum(F.when(F.col("diag") - F.lag("diag").over(along) > GAP, 1).otherwise(0)).over(along))
    runs = runs.join(F.broadcast(about), "tpl", "left")
    # each diagonal: the share of the template on it, its first and its last word in the text
    whole = F.col("base") & (F.size("at") == F.col("n_grams"))
    runs = runs.select(
        "*", whole.alias("whole"), (F.size("at") / F.col("n_grams")).alias("share"), (F.col("diag") + F.array_min("at")).alias("begin"), (F.col("diag") + F.array_max("at") + F.col("g")).alias("end")
    )
    alone = F.struct(F.col("share"), (-F.col("begin")).alias("back"), F.col("end"))
    spans = runs.groupBy("row_id", "doc_id", "n_words", "tpl", "label", "base", "n_tpl", "n_grams", "run").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("at")))) / F.col("n_grams")).alias("covered"),
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.max(alone).alias("best"),
        F.sum(F.when(F.col("whole"), 1).otherwise(0)).alias("places"),
        F.min(F.when(F.col("whole"), F.col("diag"))).alias("first"),
        F.max(F.when(F.col("whole"), F.col("diag"))).alias("last"),
    )
    fits = F.col("end") - F.col("begin") <= SPAN * F.col("n_tpl")
    covered = F.when(F.col("base") | ~fits, F.col("best.share")).otherwise(F.col("covered"))
    begin = F.when(F.col("base") | ~fits, -F.col("best.back")).otherwise(F.col("begin"))
    end = F.when(F.col("base") | ~fits, F.col("best.end")).otherwise(F.col("end"))
    spans = spans.withColumns({"_share": covered, "_begin": begin, "_end": end})
    found = F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("_share") >= NEEDED)
    label, is_base = F.when(found, F.col("label")), F.when(F.col("places") > 0, F.col("label"))
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    said = F.struct(F.col("_begin").alias("begin"), F.concat_ws(":", "label", "_begin", "_end").alias("said"))
    return spans.groupBy("row_id", "doc_id", "n_words").agg(
        F.sum("places").cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        join(is_base).alias("base_labels"),
        join(label).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("_share"))), F.lit(0.0)).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(found, said))), lambda x: x["said"]), ",").alias("spans"),
    )
