"""Encoding whole texts with a tokenizers file, one library call per distinct piece between spaces.

Both vocabularies used here cut a text at every single space before they merge, so the ids of a text are the ids of
its pieces put together. A task keeps the ids of the pieces it has met (a bounded number; later ones are encoded anew
per batch), splits and numbers the pieces with Arrow, and gathers the ids with numpy. Texts where a cut at a space
could change the result (a space between other white space, or a special token's string) are encoded whole.

The word vocabulary lower-cases and cuts a piece into letters, digits and signs before it merges. For pieces of plain
characters that is done here, so that the library's merges are asked once per distinct word, not once per word with its
capital, full stop or line end.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSAFE = rf"{SPACE} {SPACE}|{SPACE} \z"
CACHED_PIECES = 700_000
CALL_PIECES = 4096
MARK = "\x01"

# Steps before the merges of the word vocabulary, for which a piece of plain characters is cut by WORDS. Plain are ASCII
# white space, printable ASCII but the apostrophe (of contractions), and the letters of Latin-1, which have one composed form.
WORD_STEPS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(rf"[\t-\r\x20-\x26\x28-\x7e{LATIN}]*")
WORDS = re.compile(rf"[{LATIN}]+|[0-9]|{MARK}|[^{LATIN}0-9\t-\r\x20{MARK}]+")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class PieceCache:
    """Ids of whole texts put together from the ids of their pieces; subclasses say how a piece is encoded."""

    spaced: bool  # whether a piece carries the space before it
    special: list[str] = []  # strings that are encoded across pieces

    def __init__(self, cached: int = CACHED_PIECES):
        self.cached = cached
        self.cache: dict[str, bytes] = {"": b""}

    def ids_of(self, text: str) -> list[int]:
        raise NotImplementedError

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        return [np.array(self.ids_of(piece), "<u4").tobytes() for piece in pieces]

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        found = [self.cache.get(p) for p in pieces]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self.ids_of_pieces([pieces[i] for i in missing])):
            found[i] = ids
        for i in missing[: max(0, self.cached - len(self.cache))]:
            self.cache[pieces[i]] = found[i]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of each text's ids); null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNSAFE) if self.spaced else pa.array(np.zeros(len(texts), bool))
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        split = pc.split_pattern(pc.if_else(odd, "", texts) if len(whole) else texts, " ")
        counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        codes = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = numbered.dictionary.to_pylist()
        if self.spaced:  # the first piece of a text has no space before it
            at = np.cumsum(counts) - counts
            first, codes_first = np.unique(codes[at], return_inverse=True)
            pieces = [" " + p for p in pieces] + [pieces[i] for i in first.tolist()]
            codes[at] = len(numbered.dictionary) + codes_first
        known = self._lookup(pieces)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        each = lengths[codes]
        before = np.cumsum(each) - each
        ids = pool[np.repeat((np.cumsum(lengths) - lengths)[codes] - before, each) + np.arange(each.sum())]
        bounds = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
        if len(whole):
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            for i in whole.tolist():
                parts[i] = np.array(self.ids_of(texts[i].as_py()), "<u4")
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


class PieceEncoder(PieceCache):
    """Ids by the tokenizers file at `path`, special tokens not added."""

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        from tokenizers import Tokenizer

        super().__init__(cached)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A byte-level vocabulary puts the space before a word into the word's piece; the other kind drops it.
        self.spaced = self.ids_of("a b") != self.ids_of("a") + self.ids_of("b")
        self.mark = "\n" if self.spaced else f" {MARK} "
        (self.mark_id,) = self.ids_of(self.mark)
        self.joinable = re.compile(r" ?\S+").fullmatch if self.spaced else (lambda piece: MARK not in piece)
        steps = json.loads(self.tokenizer.to_str())
        self.by_words = all((steps[k] or {}).get("type") == "Sequence" and steps[k].get("normalizers", steps[k].get("pretokenizers")) == own for k, own in WORD_STEPS.items())
        self.words: dict[str, bytes] = {}

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Plain pieces by their words; others are put together with a mark that keeps them apart, to save calls."""
        out: dict[str, bytes] = {}
        if self.by_words:
            text = MARK.join(pieces)
            if PLAIN.fullmatch(text.replace(MARK, "")) and text.count(MARK) == len(pieces) - 1:
                return self._ids_by_words(pieces)
            plain = [p for p in pieces if PLAIN.fullmatch(p)]
            out.update(zip(plain, self._ids_by_words(plain)))
        joined = [p for p in pieces if p and p not in out and self.joinable(p)]
        for at in range(0, len(joined), CALL_PIECES):
            part = joined[at : at + CALL_PIECES]
            text = self.mark.join(part) + self.mark
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(part):
                raise ValueError("the mark between pieces did not keep them apart")
            begin = 0
            for piece, end in zip(part, ends.tolist()):
                out[piece] = ids[begin:end].tobytes()
                begin = end + 1
        alone = [p for p in pieces if p not in out]
        out.update(zip(alone, super().ids_of_pieces(alone)))
        return [out[p] for p in pieces]

    def _ids_by_words(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        merged, known = self.tokenizer.model.tokenize, self.words
        cut = pa.array(WORDS.findall(MARK.join([*pieces, ""]).lower())).dictionary_encode()
        codes, names = cut.indices.to_numpy(zero_copy_only=False), cut.dictionary.to_pylist()
        for word in names:
            if word not in known:
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
                known[word] = array("I", [token.id for token in merged(letters)]).tobytes()
        known[MARK] = b""
        ids = [known[word] for word in names]
        if len(known) > self.cached:
            known.clear()
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))[codes])[codes == names.index(MARK)].tolist()
        every = b"".join([ids[code] for code in codes.tolist()])
        return [every[begin:end] for begin, end in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per file in each Python worker."""
    return PieceEncoder(path)
