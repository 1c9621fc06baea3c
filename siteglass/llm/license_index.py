"""Licence notices by a positional index of rare words.

The templates' words are weighed by inverse document frequency over the whole corpus. A file looks up its rarest
licence words in the index of template postings; every posting votes for a template and the place where the template
would begin. Votes that agree in place add up to the share of the template's weight that stands there, and templates
that reach the threshold are verified by a phrase that must occur in the file. DataFrame functions only; one projection
over the texts, and a shuffle of the votes alone.

Defined cases: null text is empty (no words, score 0); a null doc_id and repeated rows are carried; an empty table gives
no rows; ties between places of one template count once; other columns are ignored. `docs` should be a stored table, as
rows are told apart by their place in its scan.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import stored, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base matches.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Notices as they are commonly worded: label, words, and the phrase that must be there.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]
RARE_WORDS = 5  # of a template, and looked up of a file per template
LEAST_SHARE = 0.7


def words_of(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def _starts(words: Column, joined: Column, phrase: str) -> Column:
    """Places where the phrase's words stand one after the other; looked for only in texts that have them."""
    parts = phrase.split()

    def stands_at(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return found

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands_at)
    return F.when(joined.contains(f" {phrase} "), places).otherwise(F.array().cast("array<int>"))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and for each word of the templates in how many it occurs: one row per template word."""
    vocabulary = sorted({w for _, words, _ in TEMPLATES for w in words.split()})
    held = F.array_intersect(words_of(whole_text()), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counts}
    return found.pop("", 0), found


def rare_postings(total: int, frequency: dict[str, int]) -> list[tuple[str, int, int, float]]:
    """(word, template, position, share of the template's weight) of the rarest words of each template."""
    out = []
    for template, (_, text, _) in enumerate(TEMPLATES):
        parts = text.split()
        weight = [math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1e-6 for w in parts]
        rarest = sorted(range(len(parts)), key=lambda i: (-weight[i], i))[:RARE_WORDS]
        whole = sum(weight[i] for i in rarest)
        out += [(parts[i], template, i, weight[i] / whole) for i in rarest]
    return out


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    index: dict[str, list[tuple[int, int, float]]] = {}
    for word, template, position, share in rare_postings(*document_frequencies(docs)):
        index.setdefault(word, []).append((template, position, share))
    entry = lambda t, p, s: F.struct(F.lit(t).alias("template"), F.lit(p).alias("position"), F.lit(s).alias("share"))
    postings = F.create_map(*[x for word, found in index.items() for x in (F.lit(word), F.array(*[entry(*p) for p in found]))])
    known = F.array(*map(F.lit, index))

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_place"), words_of(whole_text()).alias("words"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"base_{k}", _starts(F.col("words"), F.col("joined"), phrase))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(known, x["word"]))
    votes = F.flatten(
        F.transform(
            hits,
            lambda x: F.transform(
                F.element_at(postings, x["word"]),
                lambda p: F.struct(p["template"].alias("template"), (x["at"] - p["position"]).alias("begin"), p["position"].alias("position"), p["share"].alias("share")),
            ),
        )
    )
    verified = [F.when(F.col("joined").contains(f" {phrase} "), F.lit(t)) for t, (_, _, phrase) in enumerate(TEMPLATES)]
    starts = [F.col(f"base_{k}") for k in range(len(BASE))]
    every = F.concat(*starts)
    found = [F.when(F.size(s) > 0, F.lit(label)) for s, (_, label) in zip(starts, BASE)]
    rows = rows.withColumn("verified", F.array_compact(F.array(*verified)))
    narrow = stored(
        rows.select(
            "doc_id",
            "_place",
            F.size("words").cast("long").alias("n_words"),
            F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))).alias("base"),
            # Votes of templates whose phrase is missing need not be counted.
            F.when(F.size("verified") > 0, F.filter(votes, lambda v: F.array_contains("verified", v["template"]))).alias("votes"),
        ),
        "words",
    )
    label_of = F.create_map(*[x for t, (label, _, _) in enumerate(TEMPLATES) for x in (F.lit(t), F.lit(label))])
    cast = narrow.select("_place", F.explode("votes").alias("vote")).select("_place", "vote.*").distinct()
    matched = (
        cast.groupBy("_place", "template", "begin").agg(F.sum("share").alias("share")).where(F.col("share") >= LEAST_SHARE)
        .groupBy("_place").agg(F.collect_set(F.element_at(label_of, F.col("template"))).alias("more"), F.max("share").alias("share"))
    )
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0))))
    return narrow.join(matched, "_place", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score")
    )
