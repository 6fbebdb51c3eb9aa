"""License scan by diagonal voting.

Every rolling pair of words of a document is hashed and joined to the places of the same pair in the
license templates. A hit lies on the diagonal (document place - template place); hits are counted by
diagonal, neighbouring diagonals of a long template are merged, and a merged span is a find if it holds
enough of the template's words. Pairs are compared by their words after the hash join, so no find rests on
a hash alone. Base phrases are templates of their own: a place counts when all their pairs lie on one
diagonal.

Defined results: NULL and empty texts have no words, no place and no label; a document with fewer than two
words has no pair and no label. The templates are fixed in this module, so their broadcast has a fixed size.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import saved, steps, text_key, text_of, words_of

# What separates words, base phrases with labels, and license wording with labels.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc", "this work is licensed under a creative commons attribution license"),
]
LEAST_SHARE = 0.6  # of a template's words, for a find
DRIFT = 3  # diagonals this near, of one template, are one span


def template_pairs(spark: SparkSession) -> DataFrame:
    """pair hash, template, label, is_base, template length, place, the two words: one row per place."""
    rows = [(label, True, text) for text, label in BASE.items()] + [(label, False, text) for label, text in TEMPLATES]
    values = []
    for number, (label, base, text) in enumerate(rows):
        words = text.split()
        values += [f"({number}, '{label}', {base}, {len(words)}, {i}, '{a}', '{b}')"
                   for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t(template, label, base, size, place, first, second)")
    return table.select(F.xxhash64("first", "second").alias("pair"), "*")


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("_key"), words_of(F.lower(text_of()), NOT_WORD).alias("words"))


def hits(docs: DataFrame) -> DataFrame:
    """One row per word pair of a document that stands in a template: the join of all rolling pairs."""
    words = F.col("words")
    pairs = F.transform(steps(F.size(words) - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
    rolled = _words(docs).select("doc_id", "_key", "words", F.posexplode(pairs).alias("at", "pair"))
    same = (F.get("words", F.col("at")) == F.col("first")) & (F.get("words", F.col("at") + 1) == F.col("second"))
    return (
        rolled.join(F.broadcast(template_pairs(docs.sparkSession)), "pair")
        .filter(same)
        .select("doc_id", "_key", "template", "label", "base", "size", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    )


def spans(docs: DataFrame) -> DataFrame:
    """Finds: doc_id, _key, label, base, first_word, share. Base finds are exact places."""
    by = ["doc_id", "_key", "template", "label", "base", "size"]
    # Repeated rows vote once: places are counted as a set, at most a template long.
    voted = saved(hits(docs).groupBy(*by, "diagonal").agg(F.collect_set("place").alias("places")), "license-votes")
    base = voted.filter("base AND size(places) = size - 1").select(
        "doc_id", "_key", "label", "base", F.col("diagonal").cast("long").alias("first_word"), F.lit(1.0).alias("share")
    )
    order = Window.partitionBy("doc_id", "_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True))
    merged = (
        voted.filter("NOT base")
        .withColumn("_new", apart.cast("int"))
        .withColumn("_span", F.sum("_new").over(order))
        .groupBy(*by, "_span")
        .agg(F.min("diagonal").alias("diagonal"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    )
    # Pairs i and i + 1 cover the template words that a hit proves.
    covered = F.size(F.array_distinct(F.concat("places", F.transform("places", lambda p: p + 1))))
    long = merged.select(
        "doc_id", "_key", "label", "base",
        F.greatest(F.col("diagonal") + F.array_min("places"), F.lit(0)).cast("long").alias("first_word"),
        (covered / F.col("size")).alias("share"),
    ).filter(F.col("share") >= LEAST_SHARE)
    return base.unionByName(long)


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places, labels and the best share of a template found."""
    only_base = F.when(F.col("base"), F.col("first_word"))
    found = spans(docs).groupBy("doc_id", "_key").agg(
        F.count(only_base).alias("n_base"), F.min(only_base).alias("first_word"), F.max(only_base).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("_base"), F.collect_set("label").alias("_all"),
        F.max("share").alias("score"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    d, f = _words(docs).select("doc_id", "_key", F.size("words").cast("long").alias("n_words")).alias("d"), found.alias("f")
    return d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d._key") == F.col("f._key")), "left").select(
        "d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined("_base").alias("base_labels"), joined("_all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
