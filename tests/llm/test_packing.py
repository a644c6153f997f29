"""Token ids of texts with very long white space."""

import numpy as np
import pytest

import public_tokenizers
from tidemark.llm import packing


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return packing.tokenizer_of(packing.vocabulary_path()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(both, text):
    fast, plain = both
    assert np.array_equal(np.frombuffer(fast.encode(text), "<u4"), plain.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\u00a0", "\r\n", "\u3000 ", "\x85"])
def test_a_million_signs_of_white_space(both, space):
    long = space * (1_000_000 // len(space))
    ids_of(both, f"before{long}after the space")


@pytest.mark.parametrize("around", [("", ""), ("a", ""), ("", "b"), ("a", " b"), ("a.", "<|endoftext|>b"), ("<|endoftext|>", "\n\u200bx"), ("x\x1c", "\x1cy"), ("é", "7")])
def test_cuts_are_where_words_end(both, around, monkeypatch):
    for space in (" ", "\n", " \n", "\u2003"):
        for n in (packing.LONGEST_SPACE, packing.LONGEST_SPACE + 1, packing.LONGEST_SPACE + 2):
            run = (space * n)[:n]
            ids_of(both, around[0] + run + around[1])
            ids_of(both, around[0] + run + around[1] + " " + run + around[0])
