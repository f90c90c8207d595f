"""Very long pre-tokens: exact counts from composed chunk maps, in a bounded number of states."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def _words():
    rng = random.Random(2)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "x" * 20_000, "ab" * 9000, "=" * 12_000, "é" * 7000, "".join(rng.choice(["the", "and", "ing", "Zq"]) for _ in range(6000))]


@pytest.mark.parametrize("chunk, states", [(4096, 50_000), (64, 500), (1000, 200)])
def test_long_words_equal_the_library(monkeypatch, library, chunk, states):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    machine = token_counts.Merger(BPE, states)
    for word in _words():
        assert machine.count(word.encode()) == len(library.encode(word, add_special_tokens=False).ids)
        assert len(machine.states) <= states + 2


def test_states_are_bounded_inside_a_word():
    rng = random.Random(5)
    machine = token_counts.Merger(BPE, 2000)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)).encode()
    assert machine.count(word) > 50_000 and len(machine.states) <= 2002 and len(machine.moves) <= 2002 * 256


def test_maps_compose():
    machine = token_counts.Merger(BPE)
    word = b"internationalisation" * 40
    whole = machine.run(token_counts.FRESH_STATE, word)
    for cut in (1, 7, 399, 799):
        middle, first = machine.run(token_counts.FRESH_STATE, word[:cut])
        end, second = machine.run(middle, word[cut:])
        assert (end, first + second) == whole
