"""Encoding, Re-Pair shards, prefix BPE, packing and the length histogram."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from siteglass.llm import best_fit, length_histogram, repair
from siteglass.llm.bpe_prefix import PrefixEncoding, PrefixPieces, encode_and_decode
from siteglass.llm.queries import QUERIES
from siteglass.llm.subword import PieceEncoder
from tests.llm.conftest import table

SMALL = "/root/testdata/sf0.001"
CASES = [
    (4, "one two"), (2, None), (9, ""), (2, None), (7, "x  y\n \nz   "), (None, "no id"), (11, "<|endoftext|> a"),
    (3, "word " * 60000), (5, "a" * 30000), (6, "é中\U0001f600 \x01"), (8, "one two"),
]
ALPHABET = "ab e'\n\t  sdèñ12中\U0001f600ᄀ​\x1c\xa0.,!-_AB\x01ḰH̱"


def odd_texts(n=1500):
    draw = random.Random(7)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 50))) for _ in range(n)] + ["", "a" * 2000, " " * 500, "\n\n a  "]


def documents(folder):
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def prefix():
    return PrefixPieces(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("cached", [0, 50, 10**6])
def test_pieces_give_the_library_s_ids(name, cached):
    texts = odd_texts() + [t for _, t in documents(SMALL)] + ["<|endoftext|> and <|startoftext|>x"]
    pieces, library = PieceEncoder(vocabularies.path(name), cached), Tokenizer.from_file(vocabularies.path(name))
    for _ in range(2):  # without and with what is cached
        ids, bounds = pieces.encode(pa.array([*texts, None]))
        assert len(pieces.cache) <= cached + 1
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert bounds[-1] == bounds[-2]


def test_plain_pieces_share_their_words():
    """Capitals, signs and line ends make no new words, and the ids are the library's."""
    pieces = PieceEncoder(vocabularies.path("word_bpe_49k.json"))
    texts = ["Haus haus. HAUS,\nHaus; 12.Haus", "größe Größe! GRÖSSE?", "l'Haus don't Haus's", "h́aus ſ K"]
    ids, bounds = pieces.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(pieces.words) - {"\x01"} == {"haus", ".", ",", ";", "1", "2", "größe", "grösse", "!", "?", "k"}
    assert not PieceEncoder(vocabularies.path("byte_bpe_50k.json")).by_words


def test_prefix_encoding_is_tiktoken_s(prefix):
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=prefix.ranks.ranks, special_tokens={})
    texts = odd_texts() + [t for _, t in documents(SMALL)]
    ids, bounds = prefix.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode_ordinary(text), text


def test_appends_and_edits_equal_encoding_anew(prefix):
    draw = random.Random(3)
    for _ in range(200):
        text = "".join(draw.choice("the andering  12") for _ in range(draw.randint(1, 300))).encode()
        cut = draw.randint(0, len(text))
        assert PrefixEncoding(prefix.ranks, text[:cut]).append(text[cut:]).last == PrefixEncoding(prefix.ranks, text).last
        start = draw.randint(0, len(text))
        stop = draw.randint(start, min(len(text), start + 6))
        new = draw.choice([b"", b"x", b"theing"])
        edited = PrefixEncoding(prefix.ranks, text).edit(start, stop, new)
        anew = PrefixEncoding(prefix.ranks, text[:start] + new + text[stop:])
        assert (edited.text, edited.last, edited.ids()) == (anew.text, anew.last, anew.ids())


def test_op8_over_its_table(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabularies.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def expected(doc, text):
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        return doc, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()

    got = sorted(map(tuple, QUERIES["op8_prefix_bpe"](spark, SMALL).collect()))
    assert got == sorted(expected(*row) for row in documents(SMALL))
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    cases = encode_and_decode(table(spark, CASES), path, vocabularies.PATTERN).collect()
    assert sorted(map(str, map(tuple, cases))) == sorted(str(expected(*row)) for row in CASES)
    assert encode_and_decode(table(spark, []), path, vocabularies.PATTERN).count() == 0


def test_repair_round_trip_and_random_access():
    draw = np.random.default_rng(1)
    for vocabulary, size in ((3, 4000), (50, 3000), (40000, 2000), (2, 1)):
        ids = draw.integers(2, 2 + vocabulary, size).astype(np.uint32)
        cuts = np.sort(draw.integers(0, size + 1, 12))
        bounds = np.concatenate([[0], cuts, [size]])
        grammar = repair.compress(ids, bounds, 49408)
        assert (repair.expand(grammar, grammar.sequence) == ids).all()
        if vocabulary < 10 and size > 1:
            assert len(grammar.sequence) < 0.6 * size and len(grammar.rules)
        for k in range(len(bounds) - 1):
            n = bounds[k + 1] - bounds[k]
            own = grammar.sequence[grammar.starts[k] : grammar.starts[k + 1]]
            assert (repair.expand(grammar, own) == ids[bounds[k] : bounds[k + 1]]).all()
            for start, stop in ((0, n), (n // 3, n // 2), (n // 2, n)):
                assert (repair.decode_range(grammar, k, start, stop) == ids[bounds[k] + start : bounds[k] + stop]).all()


def repair_expected(rows):
    library = Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op1_over_its_table(spark):
    got = sorted(map(tuple, QUERIES["op1_repair_shards"](spark, SMALL).collect()))
    assert got == repair_expected(documents(SMALL))


def test_op1_defined_cases_in_small_shards(spark, tmp_path):
    path, name = str(tmp_path / "shards"), vocabularies.path("word_bpe_49k.json")
    rows = [c for c in CASES if c[0] != 2] + [(2, None), (2, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        repair.write_shards(table(spark, rows).repartition(3), name, 1, path, shard_ids=1000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.read.parquet(path).count() > 1
    got = sorted(map(tuple, repair.read_shards(spark, path, 49408).collect()), key=lambda r: r[1])
    assert got == repair_expected(rows)
    assert repair.encode_to_files(table(spark, []), name, 1).count() == 0


def check_packing(rows, found, byte_bpe, capacity=2048):
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        assert 0 < r.length <= capacity
    for doc, text in rows:
        ids = np.array([*byte_bpe.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[doc], key=lambda r: r.piece)
        copies = sum(d == doc for d, _ in rows)
        for piece, start in enumerate(range(len(ids) - capacity * ((len(ids) - 1) // capacity) - capacity, len(ids), capacity)):
            same = own[piece * copies : (piece + 1) * copies]
            begin, end = max(start, 0), start + capacity
            assert [(r.piece, r.start, r.length, r.ids_crc32) for r in same] == [(piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes()))] * copies
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(r.length for r in found)


def test_op6_over_its_table(spark, byte_bpe):
    found = QUERIES["op6_best_fit_packing"](spark, SMALL).collect()
    used, total = check_packing(documents(SMALL), found, byte_bpe)
    assert used <= -(-total // 2048) + 1


def test_op6_defined_cases_and_groups(spark, byte_bpe):
    found = best_fit.pack_documents(table(spark, CASES), vocabularies.path("byte_bpe_50k.json")).collect()
    check_packing(CASES, found, byte_bpe)
    assert best_fit.pack_documents(table(spark, []), vocabularies.path("byte_bpe_50k.json")).count() == 0


def test_best_fit_takes_the_tightest_bin():
    draw = np.random.default_rng(5)
    for capacity in (1, 7, 64, 100):
        lengths = np.sort(draw.integers(1, capacity + 1, 300))[::-1]
        bins, offsets = best_fit.best_fit_decreasing(lengths, capacity)
        rooms = []
        for length, bin_id, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
            fitting = [room for room in rooms if room >= length]
            if bin_id == len(rooms):
                assert not fitting
                rooms.append(capacity)
            else:
                assert rooms[bin_id] == min(fitting)
            assert offset == capacity - rooms[bin_id]
            rooms[bin_id] -= length


def test_op10_over_its_table(spark, byte_bpe):
    lengths = [len(byte_bpe.encode(t or "", add_special_tokens=False).ids) for _, t in documents(SMALL)]
    found = QUERIES["op10_length_histogram"](spark, SMALL)
    rows = {r.length: r for r in found.collect()}
    assert {n: r.docs for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert (r.all_docs, r.all_tokens, r.truncated_tokens) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
    limits = [1, 100, 512, 2048, 10**6]
    totals = {r.context_limit: r for r in length_histogram.limit_totals(found, limits).collect()}
    for limit in limits:
        assert totals[limit].truncated_tokens == sum(min(x, limit) for x in lengths)
        assert totals[limit].docs_cut == sum(x > limit for x in lengths)
    middle = {r.share: r.length for r in length_histogram.quantiles(found, [0.5, 0.9, 1.0]).collect()}
    ordered = sorted(lengths)
    assert middle == {s: ordered[int(np.ceil(s * len(ordered))) - 1] for s in (0.5, 0.9, 1.0)}


def test_op10_defined_cases(spark, byte_bpe):
    name = vocabularies.path("byte_bpe_50k.json")
    rows = {r.length: r.docs for r in length_histogram.length_histogram(table(spark, CASES), name).collect()}
    assert rows == Counter(len(byte_bpe.encode(t or "", add_special_tokens=False).ids) for _, t in CASES)
    assert length_histogram.length_histogram(table(spark, []), name).count() == 0
