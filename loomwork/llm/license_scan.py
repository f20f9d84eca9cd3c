"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined with the positions of
the same hashes in the license templates.  Each hit votes for the diagonal
(position in the text minus position in the template); the votes are counted,
neighbouring diagonals of one template are merged, and each span is verified
against the words of its template before it counts.

Base phrases must stand word for word: all of their k-grams on one diagonal,
then an equality test on the words.  Other templates may differ in some words.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a gram.  No phrase is shorter.
K = 3
#: Diagonals this far apart, in words, are neighbours.
NEAR = 2
#: Share of a template's words that a span must hold.
COVER = 0.75

# Base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Openings of public licenses and their labels.
TEMPLATES = (
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses", "apache-2"),
    ("licensed under a creative commons attribution sharealike", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered; null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _grams(w: Column) -> Column:
    heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (K - 1), F.lit(0)))
    return F.transform(heads, lambda a, i: F.xxhash64(a, *[F.get(w, i + j) for j in range(1, K)]))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_hashes(words: Column) -> Column:
    """The hash of each run of K words."""
    return _let(words, _grams)


def template_table(spark) -> DataFrame:
    """(t, words, label, exact): a few rows, fixed in this module."""
    rows = [(i, text.split(), label, i < len(PHRASES)) for i, (text, label) in enumerate((*PHRASES, *TEMPLATES))]
    return spark.createDataFrame(rows, "t int, words array<string>, label string, exact boolean")


def _votes_of(templates: DataFrame) -> DataFrame:
    """(t, exact, at, h): the grams of the templates, some 130 rows that this module fixes."""
    return templates.select("t", "exact", F.posexplode(gram_hashes(F.col("words"))).alias("at", "h"))


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, k, t, first, hits, lo, hi): merged diagonals with votes; ``k`` is the hash of the text.

    ``first`` is the word where the template would begin, ``lo`` and ``hi`` the
    range of words hit, end exclusive.  Rows of one id and text count once.
    """
    templates = template_table(documents.sparkSession)
    votes_of = _votes_of(templates)
    text = F.coalesce("text", F.lit(""))
    grams = documents.select("doc_id", F.xxhash64(text).alias("k"), F.posexplode(gram_hashes(words_of(F.col("text")))).alias("p", "h"))
    hits = grams.join(F.broadcast(votes_of), "h")
    diagonals = hits.groupBy("doc_id", "k", "t", "exact", (F.col("p") - F.col("at")).alias("first")).agg(
        F.count_distinct("p").alias("hits"), F.min("p").alias("lo"), (F.max("p") + K).alias("hi")
    )
    w = Window.partitionBy("doc_id", "k", "t").orderBy("first")
    apart = (F.col("first") - F.lag("first").over(w) > NEAR) | F.col("exact") | F.lag("first").over(w).isNull()
    marked = diagonals.withColumn("new", apart.cast("int")).withColumn("g", F.sum("new").over(w))
    return marked.groupBy("doc_id", "k", "t", "g").agg(
        F.min("first").alias("first"), F.sum("hits").alias("hits"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the greatest share of a template's words in a verified span; 1
    where a base phrase stands.
    """
    templates = template_table(documents.sparkSession)
    found = spans(documents).join(F.broadcast(templates), "t")
    # K grams go with each word that may differ; the verification decides
    grams = F.size("words") - (K - 1)
    differ = F.size("words") - F.ceil(F.lit(COVER) * F.size(F.array_distinct("words")))
    enough = F.col("hits") >= F.when(F.col("exact"), grams).otherwise(F.greatest(grams - K * differ, F.lit(1)))
    span = F.struct("exact", "label", "words", F.col("first").cast("long").alias("first"), "lo", "hi")
    per_text = found.filter(enough).groupBy("doc_id", "k").agg(F.collect_list(span).alias("spans"))
    # only texts that share a gram with a template can have spans; the others' text needn't travel to them
    known = F.from_json(F.lit(json.dumps([r["h"] for r in _votes_of(templates).select("h").distinct().collect()])), "array<bigint>")
    seen = _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.arrays_overlap(_grams(w), known).alias("hit")))
    texts = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text", seen.alias("s"))
    texts = texts.select("doc_id", "k", F.col("s.n").cast("long").alias("n_words"), F.when(F.col("s.hit"), F.col("text")).alias("text"))
    right = per_text.select(F.col("doc_id").alias("i"), F.col("k").alias("j"), "spans")
    joined = texts.join(right, texts["doc_id"].eqNullSafe(right["i"]) & (texts["k"] == right["j"]), "left").withColumn("w", words_of(F.col("text")))

    def cover(w: Column, s: Column) -> Column:
        """1 where the words stand word for word, else their share in the hit range and its margins."""
        exactly = F.slice(w, F.greatest(s["first"], F.lit(0)).cast("int") + 1, F.size(s["words"])) == s["words"]
        lo = F.greatest(s["lo"] - 1, F.lit(0)).cast("int")
        there = F.slice(w, lo + 1, (s["hi"] - lo).cast("int") + 1)
        share = F.size(F.array_intersect(s["words"], there)) / F.size(F.array_distinct(s["words"]))
        return F.when(exactly, F.lit(1.0)).when(s["exact"], F.lit(0.0)).otherwise(F.least(share, F.lit(0.99)))

    scored = joined.select(
        "doc_id",
        "n_words",
        F.transform(
            F.coalesce("spans", F.array().cast(per_text.schema["spans"].dataType)),
            lambda s: F.struct(
                s["exact"].alias("exact"),
                s["label"].alias("label"),
                s["first"].alias("first"),
                s["lo"].alias("lo"),
                s["hi"].alias("hi"),
                cover(F.col("w"), s).alias("cover"),
            ),
        ).alias("found"),
    )
    parted = scored.select(
        "doc_id",
        "n_words",
        F.filter("found", lambda s: s["exact"] & (s["cover"] == 1.0)).alias("base"),
        F.filter("found", lambda s: ~s["exact"] & (s["cover"] >= COVER)).alias("like"),
    )
    # of templates on the same words, the best covered
    beaten = lambda s, o: (o["cover"] > s["cover"]) & (o["lo"] < s["hi"]) & (s["lo"] < o["hi"])
    verified = parted.select(
        "doc_id",
        "n_words",
        "base",
        F.concat("base", F.filter("like", lambda s: ~F.exists("like", lambda o: beaten(s, o)))).alias("all"),
    )
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    return verified.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["first"])).alias("last_word"),
        named("base").alias("base_labels"),
        named("all").alias("labels"),
        F.coalesce(F.array_max(F.transform("all", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
