"""Re-Pair goes on until nothing is left to replace."""

from collections import Counter

import numpy as np
import pytest

from siteglass.llm.repair import compress, expand


def test_op1_copies_shrink_beyond_32_times():
    one = np.random.default_rng(1).integers(0, 1000, 64)
    ids = np.tile(one, 512)
    grammar = compress(ids, np.arange(513) * 64, 1000)
    assert (expand(grammar, grammar.sequence) == ids).all() and len(grammar.sequence) == 512


def test_op1_no_pair_is_left_twice():
    draw = np.random.default_rng(2)
    for size, symbols in ((3, 1), (40, 2), (400, 3), (3000, 20), (3000, 400)):
        ids = draw.integers(0, symbols, size)
        grammar = compress(ids, np.array([0, size]), 500)
        assert (expand(grammar, grammar.sequence) == ids).all()
        sequence, places, last = grammar.sequence.tolist(), Counter(), {}
        for i, pair in enumerate(zip(sequence, sequence[1:])):
            if last.get(pair, -2) < i - 1:  # apart from its last place
                places[pair] += 1
                last[pair] = i
        assert not places or max(places.values()) == 1


def test_op1_ids_that_do_not_fit_a_symbol_stop_with_an_error():
    for ids, terminals in (([1, 70_000], 100_000), ([1, 9], 5), ([-1, 2], 5)):
        with pytest.raises(ValueError):
            compress(np.array(ids), np.array([0, 2]), terminals)
