"""Licence scan by diagonal voting.

Method: all rolling word k-gram hashes of every document are joined to the positions
of the same k-grams in licence templates. Hits are added up by diagonal, the offset
between document and template; diagonals with hardly a vote, as common words make them,
go; neighbouring diagonals, which edits drive apart, are merged; and a merged span
counts if it covers enough of its template within a span of about its length. Short
phrases are templates of their own, for which one hit is the whole phrase.

Templates are whole licence texts, a file each in ``templates`` beside this module, and
the sentences by which programs name their licence. They are part of the package, so
the joined side is small by construction. The text itself is read once and never
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.words import WordHashes, alphanumeric_words, ngrams, slices

#: Phrases, and the label of each.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Sentences that name a common public licence, and its label.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}
GRAM = 3
#: Offsets that one edit may shift a diagonal by.
NEIGHBOUR = 4
#: Share of a template that a span must cover.
COVER = 0.75
#: Votes that a diagonal of a long template needs; a shorter one needs one for each twelve of its words.
MOST_VOTES, WORDS_A_VOTE = 8, 12
#: A document's last position is reported under this key.
_WHOLE = -1


def _grams(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Hashes of all trigrams, then of all bigrams, by position."""
    w = hashes.of(words)
    return np.concatenate((ngrams(w, GRAM, salt=GRAM), ngrams(w, 2, salt=2)))


def licence_texts() -> dict[str, str]:
    """Label and text of each licence in the package."""
    found = resources.files("scholia.llm").joinpath("templates")
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(found.iterdir(), key=lambda f: f.name)}


def all_templates() -> list[tuple[list[bytes], str]]:
    """Words and label of the phrases, the sentences and the licence texts, in this order."""
    short = [(text.encode().split(), label) for text, label in [*PHRASES.items(), *TEMPLATES.items()]]
    return short + [(alphanumeric_words(text), label) for label, text in licence_texts().items()]


def _templates() -> list[tuple]:
    """Template positions by k-gram hash; phrases of two words by bigram."""
    hashes, rows = WordHashes(), []
    for number, (words, label) in enumerate(all_templates()):
        w = hashes.of(words)
        k = min(GRAM, len(w))
        votes = max(1, min(MOST_VOTES, len(w) // WORDS_A_VOTE))
        for at, value in enumerate(ngrams(w, k, salt=k).view(np.int64).tolist()):
            rows.append((value, number, at, k, len(w), votes, label))
    return rows


def document_grams(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with ``n_words`` and ``grams``, all k-gram hashes of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for first, end in slices(whole.column("text").to_pylist()):  # bounded memory for long texts
                b = whole.slice(first, end - first)
                words = [alphanumeric_words(t.as_py()) for t in b.column("text")]
                grams = [_grams(w, hashes) for w in words]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(g) for g in grams]))), pa.int32())
                listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(grams).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("row"), pa.array([len(w) for w in words], pa.int64()), listed], ["doc_id", "row", "n_words", "grams"]
                )

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n_words long, grams array<long>")


def _table(spark) -> DataFrame:
    names = ["hash", "template", "at", "gram", "words", "votes", "label"]
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.string()]
    columns = zip(*_templates(), strict=True)
    return spark.createDataFrame(pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}))


def licence_spans(docs: DataFrame) -> DataFrame:
    """One row per document and verified span, and one per document for itself (``template`` -1).

    ``row, doc_id, template, label, first, last, n, cover``: first and last start of a
    k-gram, number of hits, and share of the template covered. For the document's own
    row ``n`` is its number of words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    # The document's own row rides along, so that documents without a hit stay.
    whole = F.lit(xxhash.xxh3_64_intdigest(b"whole document") - 2**63).cast("long")
    rolled = (
        document_grams(docs)
        .withColumn("grams", F.concat("grams", F.array(whole)))
        .select("row", "doc_id", "n_words", F.posexplode("grams").alias("k", "hash"))
    )
    spark = docs.sparkSession
    own = spark.range(1).select(
        whole.alias("hash"), F.lit(_WHOLE).alias("template"), F.lit(0).alias("at"), F.lit(0).alias("gram"),
        F.lit(0).alias("words"), F.lit(1).alias("votes"), F.lit("").alias("label"),
    )
    hits = rolled.join(F.broadcast(_table(spark).unionByName(own)), "hash")
    trigrams = F.greatest(F.col("n_words") - (GRAM - 1), F.lit(0))
    hits = hits.withColumn(
        "pos", F.when(F.col("template") == _WHOLE, F.lit(0)).when(F.col("gram") == 2, F.col("k") - trigrams).otherwise(F.col("k"))
    )
    # Positions past the last trigram hold bigrams, and the other way round.
    hits = hits.where(
        (F.col("template") == _WHOLE) | F.when(F.col("gram") == 2, F.col("k") >= trigrams).otherwise(F.col("k") < trigrams)
    )
    key = ["row", "doc_id", "n_words", "template", "label", "words", "gram", "votes"]
    diagonals = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*key, "diagonal").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.collect_set("at").alias("ats"),
    ).where(F.col("n") >= F.col("votes"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    phrase = F.col("words") == F.col("gram")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOUR, F.lit(True)) | phrase
    grouped = diagonals.withColumn("span", F.sum(apart.cast("int")).over(along))
    spans = grouped.groupBy(*key, "span").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("gram") - 1))))
    )
    cover = F.when(F.col("template") == _WHOLE, 0.0).otherwise(covered / F.col("words"))
    fits = (F.col("last") - F.col("first") + F.col("gram")) <= F.col("words") * 1.5 + 2
    return (
        spans.withColumn("cover", cover)
        .where((F.col("template") == _WHOLE) | ((F.col("cover") >= COVER) & fits))
        .select(
            "row", "doc_id", "template", "label", "first", "last", "cover",
            F.when(F.col("template") == _WHOLE, F.col("n_words")).otherwise(F.col("n")).alias("n"),
        )
    )


def licence_report(docs: DataFrame) -> DataFrame:
    """One row per document: words, phrase places, labels and score.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` come from the
    phrases alone; ``labels`` adds those of verified templates; ``score`` is the
    largest share covered, 0 without a span. Null and empty texts have no words;
    repeated rows are reported one by one; an empty table gives none.
    """
    base = (F.col("template") >= 0) & (F.col("template") < len(PHRASES))
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return (
        licence_spans(docs)
        .groupBy("row", "doc_id")
        .agg(
            F.max(F.when(F.col("template") == _WHOLE, F.col("n"))).alias("n_words"),
            F.coalesce(F.sum(F.when(base, F.col("n"))), F.lit(0)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.col("template") >= 0).alias("labels"),
            F.max("cover").alias("score"),
        )
        .drop("row")
    )
