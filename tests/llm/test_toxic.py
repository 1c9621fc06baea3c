"""Class-conditional Kneser-Ney scores: the model against brute force, both routes of scoring, held-out accuracy, defined cases."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siteglass.llm import toxic_kneser_ney as K
from tests.llm.conftest import table

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grumblefrotz", "snarkwit", "zorbhead"]


def corpus(n=400, seed=3):
    draw = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tas", "vel", "or", "in"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(draw.randint(5, 60))]
        toxic = draw.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(BAD) + draw.choice(["", "s", "ed"]))
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, None, int(toxic)))
    return rows, labels


def counted(spark, rows, labels):
    docs = table(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return K.word_counts(docs.join(spark.createDataFrame(labels, LABELS).select("doc_id", "toxic"), "doc_id", "left"))


def brute_ratio(rows, labels):
    """A function of a word, by plain dictionaries."""
    toxic = dict((i, t) for i, _, t in labels)
    kinds, counts = collections.Counter(), (collections.Counter(), collections.Counter())
    words = set()
    for i, text in rows:
        for w in K.words_of(text):
            words.add(w)
            if i in toxic:
                counts[toxic[i]].update(grams(w))
    for w in words:
        kinds.update(grams(w))
    levels = {K.ORDER: kinds}
    for k in range(K.ORDER - 1, K.LOWEST - 1, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    around = {k: collections.defaultdict(list) for k in levels}
    for k, found in levels.items():
        for g, c in found.items():
            around[k][g[:-1]].append(c)

    def shared(g):
        k, own = len(g), around[len(g)][g[:-1]]
        if k == K.LOWEST:
            return levels[k][g] / sum(own)
        d = K.SHARED_DISCOUNT
        return max(levels[k][g] - d, 0) / sum(own) + sum(min(c, d) for c in own) / sum(own) * shared(g[1:])

    sums = [sum(c.values()) for c in counts]
    by_context = [collections.defaultdict(list) for _ in counts]
    for c, found in enumerate(counts):
        for g, n in found.items():
            by_context[c][g[:-1]].append(n)

    def parts(c, g):
        own, discount = by_context[c].get(g[:-1], []), K.DISCOUNT * sums[c] / min(sums)
        if not own:
            return 0.0, 1.0
        return max(counts[c][g] - discount, 0) / sum(own), sum(min(n, discount) for n in own) / sum(own)

    def ratio(word):
        total = 0.0
        for g in grams(word):
            (t, gt), (o, go) = parts(1, g), parts(0, g)
            seen = counts[0][g] + counts[1][g]
            total += math.log((t + gt * shared(g)) / (o + go * shared(g))) if seen else math.log(gt / go)
        return total

    return ratio, words


def grams(word):
    padded = " " * (K.ORDER - 1) + word + " "
    return [padded[i : i + K.ORDER] for i in range(len(word) + 1)]


def test_ratios_equal_brute_force(spark):
    rows, labels = corpus()
    ratios = K.Ratios.of(K.ratio_table(counted(spark, rows, labels)).toArrow())
    ratio, words = brute_ratio(rows, labels)
    words = sorted(words) + ["unseen", "grumblefrotzes", "ñandú", "漢字"]
    for word, got in zip(words, ratios.of_words(words).tolist()):
        assert got == pytest.approx(ratio(word), abs=1e-9), word


def test_both_routes_give_the_same_scores_and_tell_the_classes_apart(spark):
    rows, labels = corpus(1500)
    docs, marks = table(spark, rows), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in K.toxicity_scores(docs, marks).collect()}
    joined = {r.doc_id: r for r in K.toxicity_scores(docs, marks, broadcast_grams=0, broadcast_labels=0).collect()}
    assert set(got) == {i for i, _ in rows} == set(joined)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        assert joined[i].score == pytest.approx(r.score, abs=1e-9)
    asked = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in asked) >= 0.95 * len(asked)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows, labels = corpus(300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    scores = [{r.doc_id: r.score for r in K.toxicity_scores(table(spark, rows), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_defined_cases(spark):
    rows, labels = corpus(200)
    rows += [(1000, None), (1001, ""), (1002, "kalo " * 60_000), (1002, "kalo " * 60_000), (None, "kalo mi"), (1003, "x" * 5000), (1004, "... !!")]
    labels += [(1, None, None), (2, None, 7), (999_999, None, 1), (3, None, 0), (None, None, 1)]
    for most in (K.BROADCAST_GRAMS, 0):
        found = K.toxicity_scores(table(spark, rows), spark.createDataFrame(labels, LABELS), broadcast_grams=most).collect()
        assert len(found) == len(rows)
        by_id = collections.defaultdict(list)
        for r in found:
            by_id[r.doc_id].append(r)
        assert by_id[1000][0].score == by_id[1001][0].score == by_id[1004][0].score
        assert by_id[1002][0].score == by_id[1002][1].score
        assert not by_id[None][0].held_out


def test_empty_tables_and_one_class(spark):
    rows, labels = corpus(60)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in K.toxicity_scores(table(spark, rows), none).collect()} == {0.5}
    ordinary = spark.createDataFrame([(i, q, 0) for i, q, _ in labels], LABELS)
    assert {r.score for r in K.toxicity_scores(table(spark, rows), ordinary).collect()} == {0.0}
    assert K.toxicity_scores(table(spark, []), ordinary).count() == 0
    clash = table(spark, rows).withColumnRenamed("extra", "toxic").withColumnRenamed("source", "words")
    assert clash.count() == K.toxicity_scores(clash, spark.createDataFrame(labels, LABELS)).count()
