"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

A document is the set of its words (runs of word characters in lower case, a run over 40 in consecutive pieces). Each class
model gives the probability of a word letter by letter from the five letters before; its counts are documents of the class
that hold the word. Both models back off to one shared model, whose Kneser-Ney counts are the distinct words of the whole
corpus that continue a context, interpolated down to three letters. So an expression that is rare in the labelled documents
gets its probability in either class from the same counts and hardly tells the classes apart, while inflected forms of one
toxic word support each other. Both classes give the same share of their counts to the shared model at a single discount
in the smaller class.

The logarithms of the two probabilities are summed over the words of a document, and their difference is normalised by the
number of words (and by its root); a logistic curve makes it a probability. Three quarters of the labelled learning fold
give the counts, all of them; the curve is fitted on the rest, CURVE_DOCS documents at most.

Labels go to all tasks up to BROADCAST_LABELS of them, more are joined by doc_id. Tasks count their own words, then one row per word and one per letter gram are grouped. The difference of the two
models is one number per gram, and one per context for all grams without a class count. If this table has at most
BROADCAST_GRAMS rows, each task holds it; a larger one is joined with the words, and the words with the documents.

Defined cases: null and empty texts have no words and get the curve's value at 0; rows without doc_id are never held out;
labels other than 0 and 1, and labels of unknown documents, are ignored, of several labels of one document the largest
counts; without documents of one class every score is the share of toxic labels (one half without labels); repeated rows and
equal texts get equal scores and count each; very long texts are read whole; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from siteglass.llm.common import attach, slices, stored, whole_text

ORDER = 6
LOWEST = 3
DISCOUNT = 2.0  # documents of the smaller class
SHARED_DISCOUNT = 0.75
CURVE_DOCS = 20_000
BROADCAST_GRAMS = 5_000_000  # 16 bytes each
BROADCAST_LABELS = 4_000_000  # (doc_id, label) pairs; more are joined by a shuffle of the texts
HELD_WORDS = 300_000  # words that a task keeps at once
WORD = re.compile(r"\w{1,40}")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def for_curve() -> Column:
    return F.crc32(F.concat(F.lit("curve:"), F.col("doc_id").cast("string"))) % 4 == 0


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def learning_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the learning fold, one row per document."""
    rows = labels.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("toxic").isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): in how many documents of each class a word is. `docs` has text and toxic (null: no class)."""
    names = ["word", "toxic", "ordinary"]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            pairs = np.array(list(held.values()), np.int64).reshape(-1, 2)
            arrays = [pa.array(list(held), pa.string()), pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 0].copy())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    found = words_of(text)
                    if toxic is None:
                        for word in found:
                            if word not in held:
                                held[word] = [0, 0]
                    else:
                        for word in found:
                            if (count := held.get(word)) is None:
                                count = held[word] = [0, 0]
                            count[toxic] += 1
                    if len(held) > HELD_WORDS:
                        yield out()
        yield out()

    partial = docs.select("text", "toxic").mapInArrow(counts, "word string, toxic long, ordinary long")
    return partial.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def grams_of(words: DataFrame) -> DataFrame:
    """One row per letter of a word and its end: the gram that ends there, with blanks before the word."""
    grams = F.expr(
        f"transform(sequence(1, length(word) + 1), i -> substring(concat(repeat(' ', {ORDER - 1}), word, ' '), i, {ORDER}))"
    )
    return words.withColumn("gram", F.explode(grams))


def _context(order: int) -> Column:
    return F.substring("gram", 1, order - 1)


def shared_model(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, kinds, shared): the interpolated Kneser-Ney probability of the last letter of each gram after those before it.

    `kinds` counts the distinct longer expressions that a gram ends: words for the longest grams, grams one letter longer below.
    """
    of_context = Window.partitionBy(_context(order))
    rows = grams.withColumn("all", F.sum("kinds").over(of_context))
    if order <= LOWEST:
        return rows.select("gram", "kinds", (F.col("kinds") / F.col("all")).alias("shared"))
    rows = rows.withColumn("next", F.count("*").over(of_context)).withColumn("ending", F.substring("gram", 2, order))
    shorter = grams.groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("kinds"))
    below = shared_model(shorter, order - 1).select(F.col("gram").alias("ending"), F.col("shared").alias("below"))
    own = F.greatest(F.col("kinds") - SHARED_DISCOUNT, F.lit(0.0)) / F.col("all")
    left = F.least(F.col("kinds"), F.lit(SHARED_DISCOUNT))
    given = F.sum(left).over(of_context) / F.col("all")
    return rows.withColumn("given", given).join(below, "ending").select("gram", "kinds", (own + F.col("given") * F.col("below")).alias("shared"))


def ratio_table(words: DataFrame) -> DataFrame | None:
    """(gram, ratio): log toxic probability less log ordinary probability; contexts have one letter less. None: a class is empty."""
    grams = stored(
        grams_of(words).groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams"
    )
    totals = grams.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).first()
    if not totals.toxic or not totals.ordinary:
        return None
    rows = grams.join(shared_model(grams.select("gram", "kinds")).select("gram", "shared"), "gram").withColumn("context", _context(ORDER))
    of_context = Window.partitionBy("context")
    given, probability = {}, {}
    for name in ("toxic", "ordinary"):
        discount = DISCOUNT * totals[name] / min(totals.toxic, totals.ordinary)
        rows = rows.withColumn(f"all_{name}", F.sum(name).over(of_context)).withColumn(
            f"left_{name}", F.sum(F.least(F.col(name).cast("double"), F.lit(discount))).over(of_context)
        )
        seen = F.col(f"all_{name}") > 0
        given[name] = F.when(seen, F.try_divide(f"left_{name}", f"all_{name}")).otherwise(1.0)
        own = F.when(seen, F.try_divide(F.greatest(F.col(name) - discount, F.lit(0.0)), F.col(f"all_{name}"))).otherwise(0.0)
        probability[name] = own + given[name] * F.col("shared")
    rows = stored(
        rows.where("all_toxic + all_ordinary > 0").select(
            "gram", "context", (F.col("toxic") + F.col("ordinary")).alias("counts"),
            F.log(probability["toxic"] / probability["ordinary"]).alias("ratio"), F.log(given["toxic"] / given["ordinary"]).alias("given"),
        ),
        "ratios",
    )
    contexts = rows.groupBy(F.col("context").alias("gram")).agg(F.max("given").alias("ratio"))
    return rows.where("counts > 0").select("gram", "ratio").union(contexts)


def _codes(letters: np.ndarray, length: int) -> np.ndarray:
    """64-bit code of each run of `length` letters."""
    at = len(letters) - length + 1
    code = np.full(max(at, 0), length, np.uint64)
    for i in range(length):
        code = (code ^ letters[i : i + at]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


@dataclass
class Ratios:
    """The ratio table in the order of its grams' codes."""

    codes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Ratios:
        grams, values = table.column("gram").to_pylist(), table.column("ratio").to_numpy().astype(np.float64)
        long = np.array([len(g) == ORDER for g in grams], bool)
        codes = np.zeros(len(grams), np.uint64)
        for length, chosen in ((ORDER, long), (ORDER - 1, ~long)):
            which = np.flatnonzero(chosen)
            if len(which):
                codes[which] = _codes(_letters("".join([grams[i] for i in which])), length)[::length]
        order = np.argsort(codes)
        return cls(codes[order], values[order])

    def _found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.codes[place] == codes, self.values[place]

    def of_words(self, words: list[str]) -> np.ndarray:
        """The summed ratios of each word."""
        if not words:
            return np.zeros(0)
        blanks = " " * (ORDER - 1)
        letters = _letters("".join([f"{blanks}{word} " for word in words]) + blanks)
        sizes = np.array([len(word) + 1 for word in words])
        ends = np.cumsum(sizes)
        first = ends - sizes
        at = np.arange(ends[-1]) + np.repeat(np.arange(len(words)) * (ORDER - 1), sizes)
        by_gram, value = self._found(_codes(letters, ORDER)[at])
        by_context, general = self._found(_codes(letters, ORDER - 1)[at])
        return np.add.reduceat(np.where(by_gram, value, np.where(by_context, general, 0.0)), first)


def with_sums(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """`docs` without text, with the summed ratios and the number of its distinct words; every task holds the table."""
    shared = docs.sparkSession.sparkContext.broadcast((ratios.codes, ratios.values))
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Ratios(*shared.value)
        known: dict[str, float] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                found = [words_of(text) for text in part.column("text").to_pylist()]
                new = list(set().union(*found).difference(known))
                if len(known) + len(new) > HELD_WORDS:
                    known.clear()
                    new = list(set().union(*found))
                known.update(zip(new, table.of_words(new).tolist()))
                sums = [sum(sorted([known[w] for w in words])) for words in found]
                own = [part.column(f.name) for f in kept]
                extra = [pa.array(sums, pa.float64()), pa.array([len(words) for words in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(own + extra, names=[f.name for f in kept] + ["ratios", "words"])

    return docs.mapInArrow(sums, StructType([*kept, StructField("ratios", DoubleType()), StructField("words", LongType())]))


def with_joined_sums(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The same through joins, for a table of any size: equal texts once, words with grams, texts with words."""
    docs = docs.withColumn("print", F.sha2(F.col("text"), 256))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = [list(words_of(text)) for text in part.column("text").to_pylist()]
                rows = part.column("print").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
                yield pa.RecordBatch.from_arrays([rows, pa.array([w for f in found for w in f], pa.string())], names=["print", "word"])

    found = stored(docs.select("print", "text").mapInArrow(pairs, "print string, word string").distinct(), "words")
    words = stored(found.groupBy("word").agg(F.count("*").alias("texts")), "counts")
    grams = grams_of(words).withColumn("context", _context(ORDER))
    own = attach(grams, _keyed(grams, table, "gram"), "gram", "rows", F.xxhash64("word")).withColumnRenamed("ratio", "own").drop("rows")
    all_of = attach(own, _keyed(own, table, "context"), "context", "rows", F.xxhash64("word"))
    by_word = all_of.groupBy("word", "texts").agg(F.sum(F.coalesce("own", "ratio", F.lit(0.0))).alias("ratio"))
    sums = attach(found, stored(by_word, "word_ratios"), "word", "texts", F.xxhash64("print"))
    by_text = sums.groupBy("print").agg(F.sum("ratio").alias("ratios"), F.count("*").alias("words"))
    copies = docs.groupBy("print").agg(F.count("*").alias("copies")).join(by_text, "print", "left")
    kept = [c for c in docs.columns if c not in ("text", "print")]
    out = attach(docs.drop("text"), copies, "print", "copies", F.xxhash64(*kept))
    return out.select(*kept, F.coalesce("ratios", F.lit(0.0)).alias("ratios"), F.coalesce("words", F.lit(0)).alias("words"))


def _keyed(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("rows")).join(table.withColumnRenamed("gram", key), key, "left")


def _features() -> list[Column]:
    n = F.greatest(F.col("words"), F.lit(1))
    return [F.col("ratios") / n, F.col("ratios") / F.sqrt(n), F.log1p(F.col("words")) - 5, F.lit(1.0)]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the curve by Newton's method, with a slight pull to 0; those of the two ratios are 0 at least."""
    used = np.ones(x.shape[1], bool)
    while True:
        part, found = x[:, used], np.zeros(used.sum())
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(part @ found, -40, 40)))
            hessian = (part * (p * (1 - p))[:, None]).T @ part + 1e-2 * np.eye(len(found))
            found -= np.linalg.solve(hessian, part.T @ (p - y) + 1e-2 * found)
        weights = np.zeros(x.shape[1])
        weights[used] = found
        wrong = np.flatnonzero(weights[:2] < 0)
        if not len(wrong):
            return weights
        used[wrong[np.argmin(weights[wrong])]] = False


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, broadcast_labels: int = BROADCAST_LABELS,
    curve_docs: int = CURVE_DOCS,
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`; `labels` has doc_id and toxic."""
    docs = docs.select("doc_id", whole_text().alias("text"))
    learn = stored(learning_labels(labels), "labels")
    counting = learn.where(~for_curve())
    counting = F.broadcast(counting) if learn.count() <= broadcast_labels else counting
    words = word_counts(docs.join(counting, "doc_id", "left"))
    table = ratio_table(words)
    if table is None:
        shares = docs.select("doc_id").join(learn, "doc_id").agg(F.avg("toxic")).first()[0]
        scored = docs.select("doc_id", F.lit(0.5 if shares is None else float(shares)).alias("score"))
        return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    table = stored(table, "table")
    if table.count() <= broadcast_grams:
        ratios = Ratios.of(table.toArrow())
        summed = lambda rows: with_sums(rows, ratios)
    else:
        summed = lambda rows: with_joined_sums(rows, table)
    chosen = learn.where(for_curve()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(curve_docs)
    known = summed(docs.join(F.broadcast(chosen), "doc_id")).select(*[f.alias(f"f{i}") for i, f in enumerate(_features())], "toxic")
    rows = known.limit(2 * curve_docs).toArrow()
    x = np.stack([rows.column(f"f{i}").to_numpy() for i in range(4)], 1)
    weights = logistic(x, rows.column("toxic").to_numpy().astype(float)) if len(x) else np.array([1.0, 0.0, 0.0, 0.0])
    line = sum((f * float(w) for f, w in zip(_features(), weights)), F.lit(0.0))
    scored = summed(docs).withColumn("score", 1 / (1 + F.exp(-line)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
