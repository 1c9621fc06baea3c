"""Token ids of a corpus in Re-Pair compressed shard files.

Documents are sorted into ranges of doc_id; each range is encoded where it lies and written as shards of a bounded
number of ids. A shard is one row of a Parquet file: its own grammar and its documents. Frequent pairs of neighbouring
symbols are repeatedly replaced by nonterminals, many pairs at a time, counted over the whole shard; a pair never
crosses from one document into the next. The row stores the rules (two symbols each), every rule's expansion length,
the compressed sequence and where each document begins in it, so one document, or ids in its middle, can be decoded
without the rest (`decode_range`).

Defined cases: null text is empty (its end id alone); rows without a doc_id come first; repeated rows are each written;
ties of doc_id keep no set order among themselves; an empty table writes and reads no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.llm.common import shared_folder, slices, whole_text
from siteglass.llm.subword import encoder

SHARD_IDS = 1 << 20
SYMBOLS = 1 << 16  # symbols are 16 bits wide
ROUND_PAIRS = 4096
LEAST_COUNT = 2
SLOT_BITS = 16
ACROSS = np.uint32(0xFFFFFFFF)  # key of two symbols of different documents; no rule is ever made of two last symbols

SHARD = (
    "part int, shard int, first_doc_id long, n_ids long, doc_ids array<long>, doc_lengths binary, doc_starts binary, "
    "rules binary, rule_lengths binary, sequence binary"
)


@dataclass
class Grammar:
    """Symbols below `terminals` are ids; symbol terminals + i is rule i, a pair of symbols."""

    terminals: int
    rules: np.ndarray  # (n, 2), each rule over earlier symbols
    lengths: np.ndarray  # ids that each rule stands for
    sequence: np.ndarray
    starts: np.ndarray  # first symbol of each document, and the end


def _frequent_pairs(keys: np.ndarray, most: int) -> np.ndarray:
    """The pairs with LEAST_COUNT places or more, most frequent first, `most` at most."""
    ordered = np.sort(keys)
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    counts = np.diff(edges)
    often = np.flatnonzero((counts >= LEAST_COUNT) & (ordered[edges[:-1]] != ACROSS))
    return ordered[edges[often[np.argsort(-counts[often], kind="stable")[:most]]]]


def compress(ids: np.ndarray, bounds: np.ndarray, terminals: int) -> Grammar:
    """Re-Pair over documents ids[bounds[i]:bounds[i + 1]], until no pair has two places apart or no symbol is left."""
    if terminals > SYMBOLS or len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < terminals:
        raise ValueError(f"ids must lie below the vocabulary's {terminals} ids, and those fit {SYMBOLS} symbols")
    sequence = ids.astype(np.uint16)
    starts = np.asarray(bounds, np.int64)
    rules = np.zeros((0, 2), np.uint16)
    slot = lambda keys: (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    most, spent = ROUND_PAIRS, np.zeros(0, np.uint32)
    while True:
        room = SYMBOLS - 1 - terminals - len(rules)
        if len(sequence) < 2 or room <= 0:
            break
        keys = (sequence[:-1].astype(np.uint32) << np.uint32(16)) | sequence[1:]
        last = starts[1:-1] - 1
        keys[last[(last >= 0) & (last < len(keys))]] = ACROSS
        keys[np.isin(keys, spent)] = ACROSS
        pairs = _frequent_pairs(keys, min(room, most))
        if not len(pairs):
            break
        # One pair per slot of a small table; of pairs that meet in a slot the most frequent is taken, others wait.
        table, rule_of = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
        slots = slot(pairs)
        table[slots[::-1]], rule_of[slots[::-1]] = pairs[::-1], np.arange(len(pairs))[::-1]
        at = slot(keys)
        hits = np.flatnonzero(table[at] == keys)
        # Neighbouring hits overlap: along each run every second one is taken, from the left.
        new_run = np.concatenate([[True], np.diff(hits) != 1])
        run_start = np.maximum.accumulate(np.where(new_run, hits, 0))
        hits = hits[(hits - run_start) % 2 == 0]
        chosen = rule_of[at[hits]]
        uses = np.bincount(chosen, minlength=len(pairs))
        kept = np.flatnonzero(uses >= 2)
        if not len(kept):  # pairs in each other's way: fewer at once; one alone whose places overlap is done with
            if len(pairs) == 1:
                most, spent = ROUND_PAIRS, np.append(spent, pairs)
            else:
                most = len(pairs) // 2
            continue
        most = ROUND_PAIRS
        number = np.full(len(pairs), -1, np.int64)
        number[kept] = terminals + len(rules) + np.arange(len(kept))
        hits, symbols = hits[number[chosen] >= 0], number[chosen][number[chosen] >= 0]
        sequence[hits] = symbols
        stays = np.ones(len(sequence), bool)
        stays[hits + 1] = False
        removed_before = np.concatenate([[0], np.cumsum(~stays)])
        starts = starts - removed_before[starts]
        sequence = sequence[stays]
        added = pairs[kept]
        rules = np.concatenate([rules, np.stack([added >> np.uint32(16), added & np.uint32(0xFFFF)], 1).astype(np.uint16)])
    lengths = np.ones(terminals + len(rules), np.int64)
    for i, (left, right) in enumerate(rules.tolist()):
        lengths[terminals + i] = lengths[left] + lengths[right]
    return Grammar(terminals, rules, lengths[terminals:], sequence, starts)


def _expand_rules(grammar: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids that `symbols` stand for: nonterminals are replaced by their pairs until none is left."""
    symbols = symbols.astype(np.uint16)
    while len(compound := np.flatnonzero(symbols >= grammar.terminals)):
        width = np.ones(len(symbols), np.int64)
        width[compound] = 2
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint16)
        out[at] = symbols
        pair = grammar.rules[symbols[compound].astype(np.int64) - grammar.terminals]
        out[at[compound]], out[at[compound] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def expand(grammar: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids that `symbols` stand for: each different symbol is expanded once and its ids are copied to its places."""
    present = np.zeros(SYMBOLS, bool)
    present[symbols] = True
    used = np.flatnonzero(present).astype(np.uint16)
    which = (np.cumsum(present) - 1)[symbols]
    pool = _expand_rules(grammar, used)
    lengths = np.ones(len(used), np.int64)
    compound = used >= grammar.terminals
    lengths[compound] = grammar.lengths[used[compound].astype(np.int64) - grammar.terminals]
    each = lengths[which]
    shift = (np.cumsum(lengths) - lengths)[which] - (np.cumsum(each) - each)
    return pool[np.repeat(shift, each) + np.arange(each.sum())]


def decode_range(grammar: Grammar, document: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of one document. Expansion lengths find the symbols that cover them; only those are expanded."""
    own = grammar.sequence[grammar.starts[document] : grammar.starts[document + 1]].astype(np.int64)
    lengths = np.where(own < grammar.terminals, 1, np.concatenate([grammar.lengths, [0]])[np.maximum(own - grammar.terminals, -1)])
    ends = np.cumsum(lengths)
    first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
    before = ends[first - 1] if first else 0
    return expand(grammar, own[first : last + 1])[start - before : stop - before]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode `docs` and write the shards under `path` in ascending doc_id order."""

    def compress_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer)
        terminals = max(pieces.tokenizer.get_vocab_size(), end_id + 1)
        part_id, shard = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, held
            doc_ids = [doc for docs, _, _ in held for doc in docs]
            ids = np.concatenate([ids for _, ids, _ in held])
            lengths = np.concatenate([lengths for _, _, lengths in held])
            grammar = compress(ids, np.concatenate([[0], np.cumsum(lengths)]), terminals)
            known = [doc for doc in doc_ids if doc is not None]
            row = {
                "part": part_id, "shard": shard, "first_doc_id": known[0] if known else None, "n_ids": len(ids), "doc_ids": doc_ids,
                "doc_lengths": lengths.astype("<i8").tobytes(), "doc_starts": grammar.starts.astype("<i8").tobytes(),
                "rules": grammar.rules.astype("<u2").tobytes(), "rule_lengths": grammar.lengths.astype("<i8").tobytes(),
                "sequence": grammar.sequence.astype("<u2").tobytes(),
            }
            shard, held = shard + 1, []
            return pa.RecordBatch.from_pylist([row], schema=SHARD_SCHEMA)

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = pieces.encode(part.column("text"))
                # The end id behind each document.
                lengths = np.diff(bounds) + 1
                with_end = np.full(len(ids) + len(lengths), end_id, "<u4")
                with_end[np.delete(np.arange(len(with_end)), np.cumsum(lengths) - 1)] = ids
                held.append((part.column("doc_id").to_pylist(), with_end, lengths))
                size += len(with_end)
                if size >= shard_ids:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    ordered = docs.select("doc_id", whole_text().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(compress_shards, SHARD).write.parquet(path)


SHARD_SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int32()), ("first_doc_id", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.binary()), ("doc_starts", pa.binary()), ("rules", pa.binary()),
        ("rule_lengths", pa.binary()), ("sequence", pa.binary()),
    ]
)


def grammar_of(row: dict, terminals: int) -> Grammar:
    """The grammar of a stored shard."""
    number = lambda name, kind: np.frombuffer(row[name], kind)
    return Grammar(
        terminals, number("rules", "<u2").reshape(-1, 2), number("rule_lengths", "<i8"), number("sequence", "<u2"), number("doc_starts", "<i8")
    )


def shard_offsets(shards: DataFrame) -> DataFrame:
    """(part, shard, shard_start): ids before each shard, by part totals and then within each part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    inside = before(Window.partitionBy("part").orderBy("shard"))
    own = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own_start"))
    return own.join(parts, "part").select("part", "shard", (F.col("own_start") + F.col("part_start")).alias("shard_start"))


def read_shards(spark, path: str, terminals: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shard files under `path`."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = expand(grammar := grammar_of(row, terminals), grammar.sequence).astype("<u4")
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                ends = np.cumsum(lengths)
                if len(ids) != row["n_ids"] or (len(ends) and ends[-1] != len(ids)):
                    raise ValueError("a shard does not decode to its number of ids")
                sums = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["shard_start"] + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(SHARD).parquet(path)
    placed = shards.join(shard_offsets(shards.select("part", "shard", "n_ids")), ["part", "shard"])
    needed = placed.select("doc_ids", "doc_lengths", "doc_starts", "rules", "rule_lengths", "sequence", "n_ids", "shard_start")
    return needed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the ids of `docs` as compressed shards (to `path`, else to the shared folder) and read them back."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "shards")
    write_shards(docs, tokenizer, end_id, path)
    terminals = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    return read_shards(spark, path, terminals)
