"""Join of word n-gram sets by Jaccard similarity with prefix trees.

A set's grams are 64-bit hashes in one global order. Sets that can reach the threshold share almost all grams, so the
work is cut down first, by counts alone:

1. Equal sets are one set from here on (`key` is the digest of a set).
2. Of the first grams of each set (the part that any partner must share some of, plus a tenth of the set) those that no
   other set has among its own are counted; sets with too few shared ones have no partner.
3. What is left goes into prefix trees. A tree holds the sets that begin with the same gram: the root's branches are the
   shards. Several global orders are used; large shards are cut into blocks that all get the shard's first set. Walking a
   tree shares the overlap found so far among all sets below a node and leaves a subtree when the grams that remain on
   either side cannot reach the threshold, or when all its sets are connected with the probe already.
4. The links found form components. A link that the orders missed joins two components, and then nearly all grams of
   both sets occur in other components. Sets for which that holds are joined once more, without gaps: linked ones share
   a gram of the prefix in order of rarity, so the components of that index are the shards, joined in all pairs of
   blocks (each prefix gram is a shard where a component is too large). So no link is lost.

No step gathers a gram's sets, pairs up a group of copies, or sends more than a bounded block of sets to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import attach, bitmap_of, put_back, set_apart, slices, stored, whole_text, with_bit
from siteglass.operators.components import connected_components, joined_nodes

BLOCK_SETS = 256
BLOCK_GRAMS = 1 << 19
CLUSTER_SETS = 2048
STEP = 128
#: Numbers of the global orders of the first trees, and of further trees for the sets that those leave in doubt.
FIRST_ORDERS, MORE_ORDERS = range(2), range(2, 10)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the ascending hashes of its distinct word n-grams (A-Z in lower case, ASCII white space between words)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    numbered = split.flatten().dictionary_encode()
    codes = numbered.indices.to_numpy(zero_copy_only=False)
    names = numbered.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    blank = np.array([w == "" for w in names], bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    if blank.any():
        owner, codes = owner[~blank[codes]], codes[~blank[codes]]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))])
    each = hashes[codes]
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(each) - words + 1), np.uint64)
        for i in range(words):
            grams = _mixed(grams + np.uint64(i + 1)) + each[i : i + len(grams)]
        grams = _mixed(grams)
        out = []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for word in each[a:b].reshape(-1, 1):
                    short = _mixed(word * np.uint64(0x9FB21C651E98DF25) + short)
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Threshold:
    """Jaccard of at least percent/100, in integers, for numbers of grams and for columns alike."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, n):
        """Grams that a partner of a set of n grams has of it, at least."""
        return (n * self.percent + 99) // 100

    def similar(self, both: int, n: int, m: int) -> bool:
        return 100 * both >= self.percent * (n + m - both)

    def pair_overlap(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def column(self, extra: bool) -> Column:
        """Length of the prefix of a set of `n` grams; with `extra` a tenth of the set longer."""
        more = "(n + 9) div 10" if extra else "1"
        return F.expr(f"cast(least(n, n - (n * {self.percent} + 99) div 100 + {more}) as int)")

    def shared(self) -> Column:
        """Grams of the longer prefix that a partner has in its own, at least: a partner is not much smaller."""
        return F.expr(f"greatest(1, (n * {self.percent} + 999) div 1000)")


class Node:
    """A stretch of grams that all sets below share, then the children; the sets below have the places low to high, those that end here low to own."""

    __slots__ = ("grams", "children", "low", "own", "high", "shortest", "longest")

    def __init__(self, grams: np.ndarray, low: int, own: int, high: int, sizes: np.ndarray):
        self.grams, self.low, self.own, self.high = grams, low, own, high
        self.shortest, self.longest = int(sizes.min()), int(sizes.max())
        self.children: list[Node] = []


def prefix_tree(sets: list[np.ndarray], sizes: np.ndarray) -> Node:
    """The tree of ascending arrays, which are in lexicographic order."""

    def build(low: int, high: int, depth: int) -> Node:
        first, last = sets[low], sets[high - 1]
        most = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:most] != last[depth:most])
        end = depth + int(differ[0]) if len(differ) else most
        own = low
        while own < high and sizes[own] == end:
            own += 1
        node = Node(first[depth:end], low, own, high, sizes[low:high])
        low = own
        while low < high:
            stop, head = low + 1, sets[low][end]
            while stop < high and sets[stop][end] == head:
                stop += 1
            stack.append((node, low, stop, end))
            low = stop
        return node

    stack: list[tuple[Node, int, int, int]] = []
    root = build(0, len(sets), 0)
    while stack:
        parent, low, high, depth = stack.pop()
        parent.children.append(build(low, high, depth))
    return root


def tree_links(sets: list[np.ndarray], keys: list[int], labels: list[int], threshold: Threshold) -> list[tuple[int, int]]:
    """Links (key, key) enough to connect all that similar pairs connect, each to the least key; sets of one label count as connected."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    _, at, group = np.unique(np.array([labels[i] for i in order], np.int64), return_index=True, return_inverse=True)
    before = group.copy()
    root = prefix_tree(sets, sizes)
    for i, probe in enumerate(sets):
        n, stack = len(probe), [(root, 0, 0, 0)]
        while stack:
            node, depth, both, used = stack.pop()
            # A pair is looked at from its first set in the order of the tree.
            if node.high <= i + 1 or threshold.overlap(node.shortest) > n or threshold.overlap(n) > node.longest:
                continue
            if not (group[max(node.low, i + 1) : node.high] != group[i]).any():
                continue
            need = threshold.pair_overlap(n, max(node.shortest, threshold.overlap(n)))
            alive = True
            for start in range(0, len(node.grams), STEP):
                part = node.grams[start : start + STEP]
                place = probe.searchsorted(part)
                same = probe.take(place, mode="clip") == part
                both += int(np.count_nonzero(same))
                used = int(place[-1]) + bool(same[-1])
                depth += len(part)
                if both + min(n - used, node.longest - depth) < need:
                    alive = False
                    break
            if not alive:
                continue
            for j in range(max(node.low, i + 1), node.own):
                if group[j] != group[i] and threshold.similar(both, n, depth):
                    group[group == group[j]] = group[i]
            stack += [(child, depth, both, used) for child in node.children]
    links = []
    for one in np.unique(group[before != group]):  # one set of every label in it
        held = [keys[order[k]] for k in at[group[at] == one]]
        links += [(key, min(held)) for key in held if key != min(held)]
    return links


def shingled(docs: DataFrame, words: int, threshold: Threshold, whole: bool) -> DataFrame:
    """place, doc_id, n, key and grams of each row's set: all grams, or as many of the first as step 2 needs."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = gram_sets(part.column("text"), words)
                keys = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
                sizes = [len(s) for s in sets]
                if not whole:
                    sets = [s[: min(n, n - threshold.overlap(n) + (n + 9) // 10)] for s, n in zip(sets, sizes)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_place"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64)), grams],
                    names=["_place", "doc_id", "n", "key", "grams"],
                )

    columns = "_place long, doc_id long, n long, key long, grams array<long>"
    return docs.select("_place", F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(shingle, columns)


def _blocks(buckets: DataFrame, sets: DataFrame, threshold: Threshold, every_pair: bool) -> DataFrame:
    """Links (a, b) between the sets of each bucket. buckets: (bucket columns, key, label, n); sets: (key, grams).

    A bucket is cut into blocks of bounded size. With `every_pair` all pairs of blocks are joined; without, each block
    gets the bucket's first set besides its own.
    """
    by = [c for c in buckets.columns if c not in ("key", "label", "n")]
    bucket = F.xxhash64(*by).alias("bucket")
    rows = stored(buckets.select(bucket, "key", "label", "n"), "buckets")
    sizes = (
        rows.groupBy("bucket")
        .agg(F.count("*").alias("members"), F.sum("n").alias("grams_in"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("key").alias("first_key"))
        .where("low <> high")
        .withColumn("blocks", F.expr(f"cast(greatest(ceil(members / {BLOCK_SETS}), ceil(grams_in / {BLOCK_GRAMS})) as int)"))
        .drop("low", "high", "grams_in")
    )
    placed = attach(rows, sizes, "bucket", "members", F.col("key")).where("blocks IS NOT NULL").withColumn("own", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    if every_pair:
        cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.withColumn("cell_a", F.least("own", "other")).withColumn("cell_b", F.greatest("own", "other"))
    else:
        alone = F.array("own")
        first = F.when(F.col("key") == F.col("first_key"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(alone)
        cells = placed.withColumn("cell_a", F.explode(first)).withColumn("cell_b", F.col("cell_a"))
    loaded = cells.select("bucket", "cell_a", "cell_b", "key", "label").join(sets.select("key", "grams"), "key").select("bucket", "cell_a", "cell_b", "key", "label", "grams")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _cells(batches):
            links = []
            for keys, labels, sets in groups:
                if every_pair:  # rarest first
                    known, ranks = np.unique(np.concatenate(sets), return_inverse=True)
                    rank = np.argsort(np.argsort(np.bincount(ranks), kind="stable"), kind="stable").astype(np.uint64)
                    sets = [np.sort(r) for r in np.split(rank[ranks], np.cumsum([len(g) for g in sets])[:-1])]
                links += tree_links(sets, keys, labels, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    cell = ["bucket", "cell_a", "cell_b"]
    return loaded.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(join, "a long, b long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[list[int], list[int], list[np.ndarray]]]]:
    """The keys, labels and sets of each cell, for the cells that end in each batch. Rows are sorted by cell."""
    name, held = None, ([], [], [])
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, a, b, key, label = [batch.column(c).to_numpy() for c in ("bucket", "cell_a", "cell_b", "key", "label")]
        offsets, values = batch.column("grams").offsets.to_numpy(), batch.column("grams").values.to_numpy().view(np.uint64)
        changes = np.flatnonzero((bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        out = []
        for start, stop in zip([0, *changes.tolist()], [*changes.tolist(), len(key)]):
            this = bucket[start], a[start], b[start]
            if this != name and held[0]:
                out.append(held)
                held = ([], [], [])
            name = this
            held[0].extend(key[start:stop].tolist())
            held[1].extend(label[start:stop].tolist())
            held[2].extend(values[offsets[k] : offsets[k + 1]] for k in range(start, stop))
        yield out
    if held[0]:
        yield [held]


def _shards(index: DataFrame) -> DataFrame:
    """(kind, shard, key, label, n): sets to be joined with each other, from the prefix index (gram, key, label, n).

    Linked sets share a prefix gram, so they lie in one component of the graph of sets and prefix grams. A component of
    bounded size is one shard, and its sets are sent once; in a larger one each prefix gram is a shard.
    """
    firsts = index.groupBy("gram").agg(F.min("key").alias("first_key"), F.count("*").alias("holders"))
    spokes = attach(index, firsts, "gram", "holders", F.col("key")).select(F.col("key").alias("a"), F.col("first_key").alias("b"))
    clusters = stored(connected_components(spokes, "a", "b").withColumnsRenamed({"node": "key", "component": "cluster"}), "clusters")
    members = index.select("key", "label", "n").distinct().join(clusters, "key")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members")).withColumn("whole", F.col("members") <= CLUSTER_SETS)
    placed = stored(attach(members, sizes, "cluster", "members", F.col("key")), "members")
    whole = placed.where("whole").select(F.lit(0).alias("kind"), F.col("cluster").alias("shard"), "key", "label", "n")
    large = index.join(placed.where("NOT whole").select("key"), "key", "left_semi")
    return whole.union(large.select(F.lit(1).alias("kind"), F.col("gram").alias("shard"), "key", "label", "n"))


def _shared_between_labels(rows: DataFrame, least: Column) -> DataFrame:
    """Keys of `rows` (key, label, n, gram) of which at least `least` grams occur under another label too."""
    grams = rows.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("holders"))
    several = stored(grams.where("low <> high").select("gram", "holders"), "shared")
    found = attach(rows, several, "gram", "holders", F.col("key")).where("holders IS NOT NULL")
    return found.groupBy("key", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("key")


def _apart(sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The sets (key, label, n, grams) of which so many grams occur under other labels that a link to one of those is possible."""
    grams = sets.select("key", "label", "n", F.explode("grams").alias("gram"))
    return stored(sets.join(_shared_between_labels(grams, F.expr(f"(n * {threshold.percent} + 99) div 100")), "key", "left_semi"), "left_sets")


def _first_grams(sets: DataFrame, orders: range) -> DataFrame:
    """(tree, gram, key, label, n): the first gram of each set in several global orders, those of the grams hashed with a number."""
    firsts = [F.expr(f"array_min(transform(grams, g -> xxhash64(g, {i})))") for i in orders]
    return sets.select("key", "label", "n", F.posexplode(F.array(*firsts)).alias("tree", "gram"))


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """The sets with a label of connected ones; a component may keep several labels here, which only leaves more sets in doubt."""
    labels = joined_nodes(links, "a", "b").withColumnRenamed("node", "key")
    return sets.drop("label").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def set_components(rows: DataFrame, docs: DataFrame, words: int, threshold: Threshold) -> tuple[DataFrame, DataFrame]:
    """(one row per set: key, n, least doc_id, copies; component label of each linked key)."""
    reps = stored(
        rows.where("n > 0").groupBy("key", "n").agg(F.min("_place").alias("rep"), F.min("doc_id").alias("least_doc"), F.count("*").alias("copies")),
        "sets",
    )
    lone = (
        rows.select("key", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        .where("low = high").groupBy(F.col("low").alias("key")).agg(F.count("*").alias("lone"))
    )
    alive = stored(reps.join(lone, "key", "left").where(threshold.column(True) - F.coalesce("lone", F.lit(0)) >= threshold.shared()).select("key", "rep"), "alive")
    wanted = bitmap_of(alive.select(F.xxhash64("rep").alias("code")), "code")
    near = with_bit(docs.withColumn("_code", F.xxhash64("_place")), "_code", wanted, "_wanted").where("_wanted")
    near = near.join(alive.select(F.col("rep").alias("_place")), "_place", "left_semi")
    sets = stored(shingled(near, words, threshold, True).select("key", "n", F.col("key").alias("label"), "grams"), "whole_sets")
    links = stored(_blocks(_first_grams(sets, FIRST_ORDERS), sets, threshold, False), "links")
    labelled = _labelled(sets, links)
    prefix = labelled.select("key", "label", "n", F.explode(F.slice("grams", F.lit(1), threshold.column(True))).alias("gram"))
    some = stored(labelled.join(_shared_between_labels(stored(prefix, "prefix"), threshold.shared()), "key", "left_semi"), "near_sets")
    left = _apart(some, threshold)
    # For the few sets left, further orders, so that families are whole before the join without gaps.
    links = stored(links.union(_blocks(_first_grams(left, MORE_ORDERS), left, threshold, False)), "more_links")
    left = _apart(_labelled(left, links), threshold)
    holders = left.select("key", "label", "n", F.explode("grams").alias("gram"))
    counts = stored(holders.groupBy("gram").agg(F.count("*").alias("holders")), "holders")
    ordered = attach(holders, counts, "gram", "holders", F.col("key")).groupBy("key", "label", "n").agg(
        F.array_sort(F.collect_list(F.struct("holders", "gram"))).alias("by_rarity")
    )
    every = ordered.select("key", "label", "n", F.explode(F.slice("by_rarity", F.lit(1), threshold.column(False))).alias("first"))
    index = stored(every.where("first.holders > 1").select("first.gram", "key", "label", "n"), "prefix_index")
    more = _blocks(_shards(index), left, threshold, True)
    links = stored(links.union(more), "all_links")
    labels = connected_components(links, "a", "b").withColumnsRenamed({"node": "key", "component": "label"})
    return reps, labels


def similarity_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links of at least `percent` similarity reach, of every row.

    Defined cases: null or empty text, or text without words, has an empty set and is linked with nothing; fewer words
    than `words` are one gram; equal sets are linked; repeated rows share a component; a null doc_id is never the least
    (it is kept where a component has no other); an empty table gives no rows; other columns are ignored. `docs` should
    be a stored table, as rows are told apart by their place in its scan.
    """
    threshold = Threshold(percent)
    placed = docs.select("doc_id", "text").withColumn("_place", F.monotonically_increasing_id())
    rows = stored(shingled(placed, words, threshold, False), "shingles")
    reps, labels = set_components(rows, placed, words, threshold)
    linked = labels.join(reps.select("key", "least_doc"), "key")
    component = linked.groupBy("label").agg(F.min("least_doc").alias("component_doc"), F.count("*").alias("label_keys"))
    of_key = attach(labels, component, "label", "label_keys", F.col("key")).select("key", "label", "component_doc")
    component_doc = F.coalesce("component_doc", "least_doc").alias("component_doc")
    keyed = stored(reps.join(of_key, "key", "left").select("key", "copies", F.coalesce("label", "key").alias("label"), component_doc), "components")
    found = attach(rows.select("_place", "doc_id", "n", "key"), keyed, "key", "copies", F.col("_place"))
    return found.select(
        "_place", F.col("label").alias("_component"), "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_doc")).alias("component_id")
    )


def one_of_each_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The row with the least doc_id of each component, with its columns; of rows that repeat that doc_id the first."""
    found = similarity_components(docs, words, percent)
    keep = (
        found.where("n_shingles > 0").groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_place")).alias("first"))
        .select(F.col("first._place").alias("_place"))
        .union(found.where("n_shingles = 0").select("_place"))
    )
    placed = set_apart(docs).withColumn("_place", F.monotonically_increasing_id())
    return put_back(placed.join(keep, "_place", "left_semi"), docs.columns)
