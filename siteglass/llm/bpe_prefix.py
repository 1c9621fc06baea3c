"""Byte-level BPE by prefix dynamic programming.

The encoding of every prefix of a byte string ends in one certain token, and a token that ends at a place is that
token exactly if it and the last token of the prefix before it stay apart under the merges. So one pass stores the last
token of each prefix; the ids are read backwards from the end. Appending goes on from the stored prefixes, and after an
edit only the prefixes near it are worked out again. A pair of tokens is tested by undoing their merges, highest rank
first, and looking for a merge across the cut that would have come earlier.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siteglass.llm.common import slices
from siteglass.llm.subword import CACHED_PIECES, PieceCache

PAIRS_KEPT = 400_000
WHITE = r"\t-\r \x85\xa0  -     　"


class Ranks:
    """Merge ranks of byte strings, with each token's last merge and the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {rank: text for text, rank in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for text, rank in sorted(ranks.items(), key=lambda item: item[1]):
            parts = self._merge_below(text, rank)
            if len(parts) == 2:
                self.split[rank] = parts[0], parts[1]
                self.merged[parts[0], parts[1]] = rank
            else:
                self.split[rank] = rank, rank  # a single byte
        #: Every ending of a token with its rank, or -1 if it is no token: a search for tokens that end at a place stops
        #: at the first string not in here. A token that its own merges never reach counts as no token.
        self.endings = {text[i:]: -1 for text in ranks for i in range(len(text))}
        self.endings |= {text: rank for text, rank in ranks.items() if len(text) == 1 or self.split[rank] != (rank, rank)}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merge_below(self, text: bytes, limit: int) -> list[int]:
        parts = [self.ranks[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            best = min((self.merged.get(pair, limit), at) for at, pair in enumerate(zip(parts, parts[1:])))
            if best[0] >= limit:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens, one after the other, as they are."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        bound = len(self.ranks) + 1  # merges across the cut below this rank would have come first
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            inner_left, inner_right = self.split[left][1], self.split[right][0]
            if inner_left == left and inner_right == right:
                return True
            # Undo the later of the two merges; at one rank the left one came first.
            if inner_right == right or (inner_left != left and left > right):
                left, bound = inner_left, left
            else:
                right, bound = inner_right, right + 1


class PrefixEncoding:
    """The last token of every prefix of a byte string."""

    def __init__(self, ranks: Ranks, text: bytes = b""):
        self.ranks, self.text, self.last = ranks, b"", [-1]
        self.append(text)

    def _token_at(self, end: int) -> int:
        text, last, endings = self.text, self.last, self.ranks.endings
        pairs, stay_apart = self.ranks.pairs, self.ranks.stay_apart
        start = end - 1
        while start >= 0:
            token = endings.get(text[start:end])
            if token is None:
                break
            if token >= 0:
                if not start:
                    return token
                known = pairs.get((last[start], token))
                if known or (known is None and stay_apart(last[start], token)):
                    return token
            start -= 1
        raise ValueError("the ranks lack a single byte")

    def append(self, more: bytes) -> PrefixEncoding:
        begin = len(self.text)
        self.text += more
        for end in range(begin + 1, len(self.text) + 1):
            self.last.append(self._token_at(end))
        return self

    def edit(self, start: int, stop: int, new: bytes) -> PrefixEncoding:
        """Replace text[start:stop]; prefixes after the edit are kept from where they agree for a longest token's length."""
        old, shift = self.last, len(new) - (stop - start)
        tail = self.text[stop:]
        self.text, self.last = self.text[:start] + new + tail, old[: start + 1]
        longest = max(map(len, self.ranks.ranks))
        agreed = 0
        for end in range(start + 1, len(self.text) + 1):
            token = self._token_at(end)
            self.last.append(token)
            before = end - shift
            agreed = agreed + 1 if end > start + len(new) and token == old[before] else 0
            if agreed >= longest:
                self.last += old[before + 1 :]
                break
        return self

    def ids(self) -> list[int]:
        out, end = [], len(self.text)
        while end:
            out.append(self.last[end])
            end -= len(self.ranks.text[self.last[end]])
        return out[::-1]


class PrefixPieces(PieceCache):
    """Ids of whole texts: each match of the pattern is encoded by itself."""

    spaced = True

    def __init__(self, path: str, pattern: str, cached: int = CACHED_PIECES):
        super().__init__(cached)
        with open(path, "rb") as lines:
            self.ranks = Ranks({base64.b64decode(text): int(rank) for text, rank in map(bytes.split, lines)})
        white = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.matches = regex.compile(white).findall

    def ids_of(self, text: str) -> list[int]:
        return [i for match in self.matches(text) for i in PrefixEncoding(self.ranks, match.encode()).ids()]


@lru_cache(maxsize=1)
def prefix_pieces(path: str, pattern: str) -> PrefixPieces:
    return PrefixPieces(path, pattern)


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Row-local, so partitions are the input's own. Null text is empty (no ids); a null doc_id and repeated rows are
    carried; an empty table gives no rows; other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = prefix_pieces(path, pattern)
        size = max(pieces.ranks.text) + 1
        decimal = [b"%d" % i for i in range(size)]
        decoded = [pieces.ranks.text.get(i, b"") for i in range(size)]
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = pieces.encode(part.column("text"))
                digests, back = [], []
                for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                    own = ids[a:b].tolist()
                    digests.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, own))).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(decoded.__getitem__, own))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(digests), pa.array(back)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text").mapInArrow(
        encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
