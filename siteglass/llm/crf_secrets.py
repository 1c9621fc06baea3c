"""Secret scans: three fixed patterns, and a linear-chain conditional random field that adds spans of its own.

Tokens are tagged as secret begin, inside or outside. Every token of six characters or more of the secret alphabet may
be begin or inside, with digits or without, so the best tags of a text are found exactly by Viterbi over each run of
such tokens; all tokens between runs are outside. Features are the token's shape, its neighbouring words and
figures of the file. The field is fitted on a bounded sample of the corpus with the patterns' matches as labels; every
labelled run is also shown without its neighbours, so that either kind of evidence is learnt. Scanning is row-local: a
task numbers the different words of its texts, adds up their weights once, and then scores all tokens of some texts and
finds the best tags of all their runs together.

Defined cases: null text is empty (no spans); a null doc_id and repeated rows are carried; equal starts are ordered by
kind; an added span never overlaps a pattern's; without any match in the sample nothing is added; an empty table gives
no rows; other columns are carried or ignored as said.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.common import sample_documents, slices, whole_text

# Kind, pattern, group that holds the secret, its least length, and a quick test for texts without any.
KINDS = [
    (
        "assign",
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        2,
        6,
        r"(?i)password|passwd|secret|token|api_?key",
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24, r"[0-9a-f]{24}"),
]
ADDED = "crf"
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
QUICK_TOKEN = r"[A-Za-z0-9+/_.=-]{6}"
# Every character of a text is in one piece: white space, a token, a shorter or foreign word, a sign.
PIECE = re.compile(r"\s+|[A-Za-z0-9+/_.=-]{6,}|[A-Za-z0-9_]+|[^\W\x00-\x7f]+|[^\w\s]")

WEIGHTS = 1 << 14
SAMPLE_DOCS = 500  # with a match, and as many others
SAMPLE_CHARS = 20_000  # of each
EPOCHS = 60
RATE = 0.3
PULL = 1e-4
SLICE = 2 << 20  # bytes of text scanned at once
FEATURES = 18  # of a token: nine of its shape, six of its neighbours, three of the file
KEPT = 400_000  # different pieces that a task keeps numbered

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str, kinds: list[int]) -> list[Span]:
    """Matches of the given kinds, by start and kind."""
    found = []
    for k in kinds:
        _, pattern, group, least, _ = KINDS[k]
        found += [(m.start(group), k, m.end(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


_CLASSES = str.maketrans({c: k for k, all_of in (("0", "0123456789"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("a", "abcdefghijklmnopqrstuvwxyz")) for c in all_of})
_AGAIN = re.compile(r"(.)\1+")
_HEX = frozenset("0123456789abcdef")


def _shape(token: str) -> tuple:
    """What the features of a token's shape are made of, but for its head."""
    classes, letters = token.translate(_CLASSES), set(token)
    kinds, size, digits = set(classes), len(token), classes.count("0")
    changes = 0 if len(kinds) == 1 else min(8, len(_AGAIN.sub(r"\1", classes)) // 4)
    signs = "".join(sorted(kinds - {"0", "A", "a"}))[:4]
    return size.bit_length(), 8 * digits // size, digits > 0, "A" in kinds, "a" in kinds, signs, letters <= _HEX, size >= 20, 8 * len(letters) // min(size, 36), changes


@lru_cache(maxsize=100_000)
def _shape_numbers(shape: tuple) -> list[int]:
    length, share, digit, upper, lower, signs, hexadecimal, long, different, changes = shape
    return _numbers([
        f"length {length}", f"digit {digit}", f"digits {share}", f"cases {upper} {lower}", f"signs {signs}", f"hex {hexadecimal} {long}",
        f"different {different}", f"changes {changes}",
    ])


def _file(text: str, tokens: int) -> list[str]:
    return [f"file tokens {tokens.bit_length()}", f"file size {len(text).bit_length() // 2}", f"file signs {'=' in text} {'{' in text}"]


def _numbers(names: list[str]) -> list[int]:
    return [zlib.crc32(name.encode(errors="surrogatepass")) % WEIGHTS for name in names]


EDGE = "-"  # stands beyond either end of a text
SHAPE, NEAR, FILE = slice(0, 9), slice(9, 15), slice(15, 18)
HIDDEN = _numbers(["hidden"])[0]
ROLES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)  # odd factors that tell the places apart


class Pieces(dict):
    """Numbers of the different pieces, and for each its length, its kind and the weight numbers of its features."""

    def __init__(self):
        super().__init__()
        self._new: list[str] = []
        self.length = np.zeros(0, np.int64)
        self.space, self.token = np.zeros(0, bool), np.zeros(0, bool)
        self.shape = np.zeros((0, 9), np.uint16)
        self.near = np.zeros((0, 5), np.uint16)  # as the word 1, 2 and 3 before, 1 and 2 after
        self[EDGE]

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self._new.append(piece)
        return number

    def settle(self) -> None:
        """Work out what is known of the pieces that have come since."""
        new, self._new = self._new, []
        space = np.array([p.isspace() for p in new], bool)
        token = np.array([TOKEN.fullmatch(p) is not None for p in new], bool)
        shape = np.zeros((len(new), 9), np.uint16)
        for i in np.flatnonzero(token):
            shape[i] = [*_shape_numbers(_shape(new[i])), zlib.crc32(b"head " + new[i][:4].encode()) % WEIGHTS]
        words = np.array([zlib.crc32(p.lower().encode(errors="surrogatepass")) for p in new], np.uint64)
        near = ((words[:, None] * ROLES & np.uint64(0xFFFFFFFF)) >> np.uint64(18)).astype(np.uint16)  # 14 bits, one number for each place
        join = lambda old, more: np.concatenate([old, more])
        self.length = join(self.length, np.array([len(p) for p in new], np.int64))
        self.space, self.token = join(self.space, space), join(self.token, token)
        self.shape, self.near = join(self.shape, shape), join(self.near, near)


@dataclass
class Tokens:
    """All tokens of some texts: text, bounds, piece, the five pieces around, and the first token of each run."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    around: np.ndarray
    runs: np.ndarray
    files: np.ndarray  # weight numbers of each text

    @classmethod
    def of(cls, texts: list[str], pieces: Pieces) -> Tokens:
        edge = pieces[EDGE]
        parts = [[edge, edge, edge, *map(pieces.__getitem__, PIECE.findall(text)), edge, edge] for text in texts]
        pieces.settle()
        sizes = np.array([len(p) for p in parts], np.int64)
        every = np.array([n for p in parts for n in p], np.int64)
        of_text = np.repeat(np.arange(len(texts)), sizes)
        # Places in the text: the edges at either side count nothing.
        length = pieces.length[every]
        first = np.cumsum(sizes) - sizes
        for at in (0, 1, 2):
            length[first + at] = 0
        length[first + sizes - 1] = length[first + sizes - 2] = 0
        ends = np.cumsum(length)
        begins = (ends - length)[first] if len(texts) else np.zeros(0, np.int64)
        word = np.flatnonzero(~pieces.space[every])
        at = np.flatnonzero(pieces.token[every[word]])
        own, text = word[at], of_text[word[at]]
        around = np.stack([every[word[at + d]] for d in (-1, -2, -3, 1, 2)], 1) if len(at) else np.zeros((0, 5), np.int64)
        end = ends[own] - begins[text]
        runs = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        counts = np.bincount(text, minlength=len(texts)).tolist()
        files = np.array([_numbers(_file(t, n)) for t, n in zip(texts, counts)], np.uint16).reshape(-1, 3)
        return cls(text, end - length[own], end, every[own], around, runs, files)

    def features(self, pieces: Pieces, near: bool = True) -> np.ndarray:
        """Weight numbers of every token; without `near` the neighbouring words are left out."""
        out = np.full((len(self.text), FEATURES), HIDDEN, np.uint16)
        out[:, SHAPE], out[:, FILE] = pieces.shape[self.piece], self.files[self.text]
        if near:
            for i in range(5):
                out[:, NEAR.start + i] = pieces.near[self.around[:, i], i]
            out[:, NEAR.start + 5] = (out[:, NEAR.start].astype(np.int64) * 31 + out[:, NEAR.start + 1]) % WEIGHTS
        return out


@dataclass
class Field:
    """Weights of (feature, tag), and of (tag, next tag); inside cannot follow outside or begin a run."""

    emit: np.ndarray
    move: np.ndarray

    def tags(self, rows: list[list[int]]) -> list[int]:
        """The best tags of a run, by Viterbi."""
        return self._best([self._sum(row) for row in rows], self.move.tolist())

    def _sum(self, row: list[int]) -> list[float]:
        return self.emit[row].sum(0).tolist()

    def scores(self, tokens: Tokens, pieces: Pieces) -> np.ndarray:
        """Summed weights of every token's features, for each tag."""
        numbers = tokens.features(pieces)
        used, which = np.unique(tokens.piece, return_inverse=True)
        return self.emit[pieces.shape[used]].sum(1)[which] + self.emit[tokens.files].sum(1)[tokens.text] + self.emit[numbers[:, NEAR]].sum(1)

    def best_tags(self, scores: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The best tags of all runs, by Viterbi over those that are long enough for each step."""
        sizes = np.diff(runs, append=len(scores))
        order = np.argsort(-sizes, kind="stable")
        first, sizes = runs[order], sizes[order]
        back = np.zeros(scores.shape, np.int8)
        tags = np.zeros(len(scores), np.int8)
        if not len(first):
            return tags
        score = scores[first] + self.move[OUTSIDE]
        best = np.zeros((len(first), 3))
        best[:] = score
        alive = [len(first)]
        for step in range(1, int(sizes[0])):
            n = int(np.searchsorted(-sizes, -step, side="left"))
            ways = best[:n, :, None] + self.move
            back[first[:n] + step] = ways.argmax(1)
            best[:n] = ways.max(1) + scores[first[:n] + step]
            alive.append(n)
        tag = best.argmax(1)
        for step in range(int(sizes[0]) - 1, -1, -1):
            n = alive[step]
            tags[first[:n] + step] = tag[:n]
            if step:
                tag[:n] = back[first[:n] + step, tag[:n]]
        return tags

    @staticmethod
    def _best(scores: list[list[float]], move: list[list[float]]) -> list[int]:
        score, back = None, []
        for own in scores:
            if score is None:
                score = [own[t] + move[OUTSIDE][t] for t in range(3)]
                continue
            ways = [[score[s] + move[s][t] for s in range(3)] for t in range(3)]
            back.append([w.index(max(w)) for w in ways])
            score = [max(w) + o for w, o in zip(ways, own)]
        tag = score.index(max(score))
        out = [tag]
        for step in reversed(back):
            tag = step[tag]
            out.append(tag)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _different(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and which of them each row is."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(row.tobytes(), len(number)) for row in np.ascontiguousarray(rows)], np.int64)
    return np.frombuffer(b"".join(number), rows.dtype).reshape(len(number), rows.shape[1]), which


def fit_field(runs: Iterable[tuple[list[list[int]], list[int]]]) -> Field:
    """Most likely weights for (features, tags) of each run, with a slight pull to 0: forward-backward and Adagrad.

    Runs are taken one by one, and only different ones are kept, with their number.
    """
    field = Field(np.zeros((WEIGHTS, 3)), np.zeros((3, 3)))
    never = np.zeros((3, 3))
    never[OUTSIDE, INSIDE] = -1e9
    batches = []
    times: Counter[tuple[bytes, bytes]] = Counter()
    width = 0
    for rows, tags in runs:
        rows = np.asarray(rows, np.uint16)
        width = rows.shape[1]
        times[rows.tobytes(), bytes(tags)] += 1
    by_length: dict[int, list] = {}
    total = sum(len(tags) * n for (_, tags), n in times.items())
    for (rows, tags), n in times.items():
        by_length.setdefault(len(tags), []).append((rows, tags, n))
    for length, same in sorted(by_length.items()):
        rows = np.frombuffer(b"".join(r for r, *_ in same), np.uint16).reshape(len(same), length, width)
        tags = np.frombuffer(b"".join(t for _, t, _ in same), np.uint8).reshape(len(same), length)
        batches.append((rows, tags, np.array([n for *_, n in same], float)))
    times.clear()
    by_length.clear()
    # Rows of features that many tokens share are summed once: shape, neighbours, file.
    parts = [slice(0, width - 9), *(slice(w, w + 1) for w in range(width - 9, width - 3)), slice(width - 3, width)] if width == FEATURES else [slice(0, width)]
    flat = np.concatenate([rows.reshape(-1, width) for rows, *_ in batches]) if batches else np.zeros((0, width), np.uint16)
    shared = [_different(flat[:, part]) for part in parts]
    ends = np.cumsum([0] + [rows.shape[0] * rows.shape[1] for rows, *_ in batches])
    total = max(1, total)
    seen_emit, seen_move = np.full(field.emit.shape, 1e-6), np.full((3, 3), 1e-6)
    for _ in range(EPOCHS):
        grad_emit, grad_move = PULL * field.emit, PULL * field.move
        move = field.move + never
        every = sum(field.emit[rows].sum(1)[which] for rows, which in shared) if batches else np.zeros((0, 3))
        errors = np.empty((len(flat), 3))
        for (rows, tags, often), begin, end in zip(batches, ends, ends[1:]):
            n, length, _ = rows.shape
            own = every[begin:end].reshape(n, length, 3)
            forward = np.empty((n, length, 3))
            backward = np.zeros((n, length, 3))
            forward[:, 0] = own[:, 0] + move[OUTSIDE]
            for t in range(1, length):
                forward[:, t] = own[:, t] + _log_sum(forward[:, t - 1][:, :, None] + move, 1)
            for t in range(length - 2, -1, -1):
                backward[:, t] = _log_sum(move + (own[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            whole = _log_sum(forward[:, -1], 1)
            error = np.exp(forward + backward - whole[:, None, None])
            error[np.arange(n)[:, None], np.arange(length), tags] -= 1
            error *= often[:, None, None]
            errors[begin:end] = error.reshape(-1, 3)
            grad_move[OUTSIDE] += error[:, 0].sum(0) / total
            if length > 1:
                pair = np.exp(forward[:, :-1, :, None] + move + (own + backward)[:, 1:, None, :] - whole[:, None, None, None])
                grad_move += np.einsum("ntab,n->ab", pair, often) / total
                grad_move -= np.bincount((3 * tags[:, :-1] + tags[:, 1:]).reshape(-1), np.repeat(often, length - 1), 9).reshape(3, 3) / total
        for rows, which in shared:
            for tag in range(3):
                weights = np.bincount(which, errors[:, tag], len(rows))
                grad_emit[:, tag] += np.bincount(rows.reshape(-1), np.repeat(weights, rows.shape[1]), WEIGHTS) / total
        seen_emit += grad_emit**2
        seen_move += grad_move**2
        field.emit -= RATE * grad_emit / np.sqrt(seen_emit)
        field.move -= RATE * grad_move / np.sqrt(seen_move)
    field.move += never
    return field


def labelled_runs(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Runs of the texts with the patterns' matches as tags, each once with and once without its neighbours."""
    pieces = Pieces()
    for text in texts:
        tokens = Tokens.of([text], pieces)
        spans, tags = base_spans(text, [0, 1, 2]), []
        last, at = None, 0
        firsts = set(tokens.runs.tolist())
        for i, (start, end) in enumerate(zip(tokens.start.tolist(), tokens.end.tolist())):
            while at < len(spans) and spans[at][2] <= start:
                at += 1
            held = next((s for s in spans[at : at + len(KINDS) + 1] if s[0] < end and start < s[2]), None)
            tags.append(OUTSIDE if held is None else INSIDE if held == last and i not in firsts else BEGIN)
            last = held
        bounds = [*tokens.runs.tolist(), len(tags)]
        for near in (True, False):
            numbers = tokens.features(pieces, near)
            for begin, end in zip(bounds, bounds[1:]):
                yield numbers[begin:end], tags[begin:end]
        if len(pieces) > KEPT:
            pieces = Pieces()


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Field:
    """The field of a corpus: fitted on up to `sample` documents with a match and as many with a token but no match."""
    match = F.col("text").rlike("|".join(f"({quick})" for *_, quick in KINDS))
    texts = sample_documents(docs, docs.where(match), sample, chars)
    texts += sample_documents(docs, docs.where(~match & F.col("text").rlike(QUICK_TOKEN)), sample, chars)
    return fit_field(labelled_runs(text for _, text in texts))


def added_spans(texts: list[str], field: Field, pieces: Pieces) -> dict[int, list[Span]]:
    """Spans that the field tags, for each text that has any."""
    tokens = Tokens.of(texts, pieces)
    tags = field.best_tags(field.scores(tokens, pieces), tokens.runs)
    firsts = np.zeros(len(tags), bool)
    firsts[tokens.runs] = True
    out: dict[int, list[Span]] = {}
    last = -1
    for i in np.flatnonzero(tags != OUTSIDE).tolist():
        found = out.setdefault(int(tokens.text[i]), [])
        if tags[i] == INSIDE and last == i - 1 and not firsts[i]:
            found[-1] = (found[-1][0], len(KINDS), int(tokens.end[i]))
        else:
            found.append((int(tokens.start[i]), len(KINDS), int(tokens.end[i])))
        last = i
    return out


def spans_of(text: str, kinds: list[int], any_token: bool, field: Field) -> tuple[list[Span], list[Span]]:
    """(pattern spans, all spans) of a text, by start and kind."""
    base = base_spans(text, kinds)
    return base, _together(base, added_spans([text], field, Pieces()).get(0, []) if any_token else [])


def _together(base: list[Span], added: list[Span]) -> list[Span]:
    if base and added:
        added = [a for a in added if not any(a[0] < b[2] and b[0] < a[2] for b in base)]
    return sorted(base + added)


def _scanned(texts: pa.Array, field: Field, pieces: Pieces) -> list[tuple[list[Span], list[Span]]]:
    """Spans of each text; texts in which a quick test finds nothing are not searched for that kind."""
    quick = [pc.match_substring_regex(texts, test).to_pylist() for *_, test in KINDS]
    tokens = np.flatnonzero(pc.match_substring_regex(texts, QUICK_TOKEN).to_numpy(zero_copy_only=False))
    every = texts.to_pylist()
    added = added_spans([every[i] for i in tokens], field, pieces)
    by_text = {int(tokens[i]): spans for i, spans in added.items()}
    out = []
    for i, text in enumerate(every):
        kinds = [k for k in range(len(KINDS)) if quick[k][i]]
        base = base_spans(text, kinds) if kinds else []
        out.append((base, _together(base, by_text.get(i, []))))
    return out


NAMES = [kind for kind, *_ in KINDS] + [ADDED]


def written(spans: list[Span]) -> str:
    return ",".join(f"{NAMES[k]}:{start}:{end}" for start, k, end in spans)


def secret_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of each kind, digest of the pattern spans, and all spans of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                pieces = pieces if len(pieces) < KEPT else Pieces()
                rows = _scanned(part.column("text"), field, pieces)
                counts = [pa.array([sum(s[1] == k for s in every) for _, every in rows], pa.int64()) for k in range(len(NAMES))]
                digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows])
                spans = pa.array([written(every) for _, every in rows])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts[:3], digests, spans, counts[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"]
                )

    columns = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(scan, columns)


def masked(text: str, spans: list[Span], mask: str) -> str:
    """The text with every span, or stretch of overlapping spans, replaced by `mask`."""
    out, end = [], 0
    for start, _, stop in spans:
        if start >= end:
            out += [text[end:start], mask]
        end = max(end, stop)
    return "".join(out) + text[end:]


def without_secrets(docs: DataFrame, field: Field, mask: str = "[secret]") -> DataFrame:
    """`docs` with the spans in column text masked (null stays null) and n_chars, where given, as the new length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                pieces = pieces if len(pieces) < KEPT else Pieces()
                texts = part.column("text")
                found = _scanned(pc.fill_null(texts, ""), field, pieces)
                new = [t if t is None or not s else masked(t, s, mask) for t, (_, s) in zip(texts.to_pylist(), found)]
                out = part.set_column(part.schema.get_field_index("text"), "text", pa.array(new, texts.type))
                yield out

    new = docs.mapInArrow(scan, docs.schema)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return new.select(*docs.columns)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Fit the field on the corpus and report the secrets of every row."""
    return secret_spans(docs, fit(docs))
