"""Best-fit-decreasing packing of encoded documents into fixed-length sequences.

Documents are encoded by the partition that holds them; only lengths and checksums move. Pieces are dealt evenly into
groups of bounded size, and each group is packed longest first: a segment tree over the remaining capacities finds the
tightest open bin in logarithmic time. With thousands of pieces a group wastes about one sequence.

Defined cases: null text is an empty document (its end id alone); a null doc_id is carried; repeated rows are packed
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import slices, stored, whole_text
from siteglass.llm.subword import encoder

CAPACITY = 2048
GROUP_PIECES = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += change
            node >>= 1

    def put(self, bin_id: int, room: int) -> None:
        self.bins[room].append(bin_id)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(bin, its room) of the open bin with the least room that holds `length`."""
        node = self.leaves + length
        while not self.tree[node]:
            while node & 1:  # a right child has nothing larger beside it
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length, given in decreasing order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, used = OpenBins(capacity), 0
    for i, length in enumerate(lengths.tolist()):
        found = opened.take(length)
        if found is None:
            found = used, capacity
            used += 1
        bins[i], offsets[i] = found[0], capacity - found[1]
        if found[1] > length:
            opened.put(found[0], found[1] - length)
    return bins, offsets


def encoded_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: a document's ids with `end_id` behind, cut from its end into `capacity` ids if longer."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = encoder(tokenizer).encode(part.column("text"))
                rows: list[tuple] = []
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = np.concatenate([ids[bounds[k] : bounds[k + 1]], end])
                    cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    rows += [
                        (doc, i, a, b - a, zlib.crc32(own[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), TYPES)], names=[n for n, _ in NAMED]
                )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(encode, PIECES)


NAMED = [tuple(c.split()) for c in PIECES.split(", ")]
TYPES = [pa.int32() if kind == "int" else pa.int64() for _, kind in NAMED]


def packed(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset. `pieces` must be a stored table: groups are dealt by a row's place in it."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="pack_group").assign(sequence_id=(key[0] << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    out = pieces.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(pack, out)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most `capacity` ids."""
    return packed(stored(encoded_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
