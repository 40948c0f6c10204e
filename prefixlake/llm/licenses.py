"""Licence scan in DataFrame operations: a positional index of rare licence words, then key phrases."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.shared import lowered, written

# Phrases and labels of the base scan.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Label, wording of the notice (words only) and its mandatory key phrase.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or any later version", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "any person or organization obtaining a copy of the software and accompanying documentation"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "eclipse public license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1 this license is copied below", "sil open font license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", "common development and distribution license"),
    ("artistic", "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", "artistic license"),
    ("eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", "licensed under the eupl"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
)
#: Of a template's words, so many with the highest IDF are looked up in files and count for its score.
TEMPLATE_WORDS = 8
#: Share of the weight of a template's rarest words that must stand at their relative positions.
COVER = 0.6
#: A run of what separates words: ASCII other than letters and digits.
GAP = r"[\x00-/:-`{-\x7F]+"


def normal_words(text: Column) -> Column:
    """The words of a text, A to Z in lower case, with one blank between; null is empty."""
    return F.trim(F.regexp_replace(lowered(text), GAP, " "))


def _any_phrase(words: Column, phrases) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | words.contains(f" {p} ")
    return found


def base_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, key, words, list, n_words, n_base, first_word, last_word, base_list): places where a phrase's words stand one after the other.

    `doc` and `key`, a number for the id (null: the least) and a hash of the text, name a text together.
    """
    pattern = " (?:" + "|".join(BASE_PHRASES) + ")(?= )"
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(2**63))).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), normal_words(F.col(text_col)).alias("words"))
    rows = rows.withColumn("list", F.split("words", " "))
    rows = rows.withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(F.size("list")).cast("long")).withColumn("words", F.concat(F.lit(" "), "words", F.lit(" ")))
    words = F.col("words")
    # Phrases share no place: each ends in a word that no other has before its end.
    n_base = F.when(words.contains(" license ") | words.contains(" cc by "), F.regexp_count(words, F.lit(pattern))).otherwise(0).cast("long")
    labels = F.array_sort(F.array_compact(F.array(*(F.when(words.contains(f" {p} "), F.lit(x)) for p, x in BASE_PHRASES.items()))))
    rows = rows.withColumn("n_base", n_base)
    some = F.col("n_base") > 0
    return rows.withColumns(
        {
            "first_word": F.when(some, spaces(F.regexp_extract("words", f"(?s)^(.*?){pattern}", 1))),
            "last_word": F.when(some, spaces(F.regexp_extract("words", f"(?s)^(.*){pattern}", 1))),
            "base_list": F.when(some, labels).otherwise(F.array().cast("array<string>")),
        }
    )


def _values(spark, rows, columns: str) -> DataFrame:
    """Fixed rows as a SQL table."""
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})")


def template_postings(spark) -> DataFrame:
    return _values(spark, [(k, w, i) for k, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())], "template, word, at")


def _known(words: Column) -> Column:
    """The distinct licence words of an array of words."""
    return F.array_intersect(F.array(*(F.lit(w) for w in sorted({w for _, text, _ in TEMPLATES for w in text.split()}))), words)


def word_idf(known: DataFrame, postings: DataFrame) -> DataFrame:
    """(word, idf) of every licence word: ln((n + 1) / (df + 1)) over all rows of `known`, whose column of this name has each text's licence words."""
    counted = known.select(F.explode(F.concat(F.array(F.lit("")), "known")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = counted.filter("word = ''").select(F.col("df").alias("n"))
    words = postings.select("word").distinct().join(F.broadcast(counted), "word", "left")
    return words.join(F.broadcast(total), how="left").select("word", F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("df", F.lit(0)) + F.lit(1))).alias("idf"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Each file's words are looked up in the postings of the templates' rarest words; those that agree on where the
    template starts in the file, weighed by IDF against all of the template's rarest words, are its cover (score: the best one).
    A label holds if the cover is COVER or more and the template's key phrase stands in the file. Only files with some key
    phrase are looked up, as no other can get a label, but with all their words. Texts are read once; what is kept of the
    others is their licence words, from which IDF is counted. The tables that are broadcast have as many rows as the
    templates have words. Null and empty texts have no words and no labels; rows that repeat id and text get the same
    result; other columns are not read.
    """
    spark = docs.sparkSession
    postings = template_postings(spark)
    phrases = dict.fromkeys(p for _, _, p in TEMPLATES)
    base = base_scan(docs, id_col, text_col).withColumn("known", _known(F.col("list"))).drop("list")
    base = written(base.withColumn("words", F.when(_any_phrase(F.col("words"), phrases), F.col("words"))))

    weighed = postings.select("template", "word").distinct().join(F.broadcast(written(word_idf(base.select("known"), postings))), "word")
    rank = Window.partitionBy("template").orderBy(F.desc("idf"), "word")
    rarest = weighed.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= TEMPLATE_WORDS)
    whole = rarest.groupBy("template").agg(F.sum("idf").alias("whole"))
    index = postings.join(rarest.select("template", "word", "idf"), ["template", "word"]).join(whole, "template").select("template", "word", "at", F.col("idf").alias("weight"), "whole")
    names = _values(spark, [(k, label, f" {phrase} ") for k, (label, _, phrase) in enumerate(TEMPLATES)], "template, label, phrase")

    files = base.filter("words IS NOT NULL").select("doc", "key", "words")
    placed = files.select("doc", "key", F.posexplode(F.split(F.trim("words"), " ")).alias("place", "word"))
    hits = placed.join(F.broadcast(index), "word").select("doc", "key", "template", (F.col("place") - F.col("at")).alias("start"), "word", "weight", "whole").distinct()
    cover = hits.groupBy("doc", "key", "template", "start").agg((F.sum("weight") / F.max("whole")).alias("cover")).groupBy("doc", "key", "template").agg(F.max("cover").alias("cover"))
    verified = cover.filter(F.col("cover") >= COVER).join(F.broadcast(names), "template").join(files.distinct(), ["doc", "key"]).filter(F.expr("contains(words, phrase)"))
    found = verified.groupBy("doc", "key").agg(F.collect_set("label").alias("found"), F.least(F.max("cover"), F.lit(1.0)).alias("score"))

    narrow = base.drop("words", "known").join(found.hint("merge"), ["doc", "key"], "left")
    both = F.array_sort(F.array_distinct(F.concat("base_list", F.coalesce("found", F.array().cast("array<string>")))))
    return narrow.select(
        F.col("doc_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_list", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
