"""Long words, rare pieces and scripts without spaces in language identification."""

import math

import numpy as np
import public_tokenizers
import pytest

from lodestar.llm import langid
from lodestar.llm.text import Words

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _words(data):
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), langid.LETTERS, lower=True)


def _log_total(word, number, logs):
    """Logarithm of the sum over all segmentations, place by place."""
    best = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        terms = [best[b] + logs[number[word[b:end]]] for b in range(max(0, end - langid.LONGEST_PIECE), end) if word[b:end] in number]
        top = max(terms)
        best[end] = top + math.log(sum(math.exp(x - top) for x in terms))
    return best[-1]


@pytest.mark.parametrize("rare", [1e-3, 1e-14])
def test_whole_words_of_any_length(rare):
    rng = np.random.default_rng(3)
    letters = [chr(0x4E00 + k) for k in range(12)]
    more = {"".join(rng.choice(letters, n)).encode() for n in (2, 2, 2, 3, 4, 5, 8, 10) for _ in range(6)} | {b"ab", b"aba", b" a", b"aaaa", b"a" * 31}
    pieces = tuple(sorted({*more, *(bytes([b]) for b in [32, *np.flatnonzero(langid.LETTERS)])}))
    p = rng.random((len(pieces), 2)) * rare
    number = {s: i for i, s in enumerate(pieces)}
    texts = ["".join(rng.choice(letters, n)) for n in (10, 33, 34, 200)] + ["a" * 40, "a" * 300, "ab" * 90, "é" * 50, "aba"]
    model = langid.Model(["x", "y"], np.zeros(2), p, pieces)
    for text in texts:
        data = text.encode()
        words = _words(data)
        scores, which = model.word_scores(words)
        assert len(which) == 1 and np.isfinite(scores).all()
        for k in (0, 1):
            want = _log_total(b" " + data, number, np.log(p[:, k])) + (len(data) + 1) * math.log(langid._LIFT)
            assert abs(scores[which[0], k] - want) < 1e-6 * abs(want) + 1e-9
    # in one chunk, each has the same score as alone
    data = " ".join(texts).encode()
    scores, which = model.word_scores(_words(data))
    for i, text in enumerate(texts):
        alone, _ = model.word_scores(_words(text.encode()))
        assert np.allclose(scores[which[i]], alone[0])


def test_expected_counts_of_long_words():
    """Each byte lies in one piece of every segmentation, so expected pieces weighted by length are all bytes."""
    pieces = tuple(langid.vocabulary_pieces(PIECES))
    for text in ["the " * 5, "internationalisation" * 40, "编程语言" * 60, "x" * 500]:
        words = _words(text.encode())
        counts = langid.expected_counts(words, np.zeros(1, np.int64), 1, pieces)[0]
        size = sum(len(w) + 1 for w in text.encode().split())
        assert abs((counts * [len(p) for p in pieces]).sum() - size) < 1e-6 * size


def test_scores_stay_between_zero_and_one(spark):
    rows = [(1, "日本語" * 400), (2, "a" * 3000), (3, "the cat and the dog"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = tuple(langid.vocabulary_pieces(PIECES))
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces), 3)) * 1e-14
    model = langid.Model(["a", "b", "c"], np.log(np.full(3, 1 / 3)), p / p.sum(axis=0) * 1e-6, pieces)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[4]["lang_pred"] == "und" and got[1]["lang_pred"] in "abc"
