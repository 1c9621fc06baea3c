"""Secrets without a digit or of six characters, and clean prose beside them."""

import numpy as np

from siteglass.llm import crf_secrets as secrets
from tests.llm.conftest import table

LETTERS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
PROSE = ["meeting", "alphabet", "paper", "Wednesday", "garden", "the", "of", "window", "President", "a", "because", "morning"]


def test_op4_tags_letter_only_and_short_secrets(spark):
    draw = np.random.default_rng(3)
    words = lambda k: " ".join(draw.choice(PROSE, k))
    code = lambda k: "".join(draw.choice(LETTERS, k))
    rows = [(i, f"{words(8)} password: {code(6 + i % 20)} {words(6)}") for i in range(200)]
    rows += [(200 + i, f"{words(20)}.") for i in range(200)]
    field = secrets.fit(table(spark, rows))
    for secret in ("QwErTyUiOpAsDfGh", "kXbQzT", "RtWqPzLmNvBx"):
        text = f"the garden password > {secret} because window"  # no pattern takes it
        base, every = secrets.spans_of(text, [0, 1, 2], True, field)
        assert base == [] and [(a, b) for a, _, b in every] == [(text.index(secret), text.index(secret) + len(secret))]
    for _ in range(50):
        assert secrets.spans_of(words(40), [0, 1, 2], True, field) == ([], [])


def test_op4_all_runs_together_get_the_tags_of_each():
    draw = np.random.default_rng(5)
    field = secrets.Field(draw.normal(size=(secrets.WEIGHTS, 3)), draw.normal(size=(3, 3)))
    field.move[0, 2] = -1e9
    texts = ["password of QwErTyUi morning abcdef12 garden, because \u00e9 window=one 2024-10-11 and so President\u3000alphabet " * 3]
    texts += ["", "short", " ".join(draw.choice(["alphabet", "a", "morning1", "\u00e9t\u00e9abcdefg", "#", "x" * 40], 400)), "abcdefgh" * 3]
    pieces = secrets.Pieces()
    tokens = secrets.Tokens.of(texts, pieces)
    got = [(i, a, b) for i, a, b in zip(tokens.text.tolist(), tokens.start.tolist(), tokens.end.tolist())]
    assert got == [(i, *m.span()) for i, text in enumerate(texts) for m in secrets.TOKEN.finditer(text)]
    tags, numbers = field.best_tags(field.scores(tokens, pieces), tokens.runs), tokens.features(pieces)
    bounds = [*tokens.runs.tolist(), len(tags)]
    for begin, end in zip(bounds, bounds[1:]):
        i = got[begin][0]
        assert all(not texts[i][got[k][2] : got[k + 1][1]].strip() and got[k + 1][0] == i for k in range(begin, end - 1))
        assert end == len(tags) or got[end][0] != i or texts[i][got[end - 1][2] : got[end][1]].strip()
        assert tags[begin:end].tolist() == field.tags(numbers[begin:end].tolist())
    alone = [secrets.spans_of(t, [0, 1, 2], True, field)[1] for t in texts]
    together = secrets.added_spans(texts, field, secrets.Pieces())
    assert [[s for s in spans if s[1] == 3] for spans in alone] == [together.get(i, []) for i in range(len(texts))]
