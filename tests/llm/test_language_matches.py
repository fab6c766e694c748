"""Matches of pieces are kept as numbers, not as one object each."""

import tracemalloc

import pytest

pytest.importorskip("ahocorasick")

from plumbline.llm.language import Lattice  # noqa: E402

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "aba"]


def test_all_pieces_of_all_words_are_found():
    words = ["abab", "b", "aßb"]
    lattice = Lattice(PIECES)
    first, last, place, piece, root, lengths = lattice.edges(words)
    want = set()
    for r, word in zip(root.tolist(), words, strict=True):
        line = "▁" + word
        want |= {(r + i, r + j, j, PIECES.index(line[i:j])) for i in range(len(line)) for j in range(i + 1, len(line) + 1) if line[i:j] in PIECES}
        want |= {(r + i, r + i + 1, i + 1, len(PIECES)) for i, c in enumerate(line) if c == "ß"}
    assert sorted(zip(first.tolist(), last.tolist(), place.tolist(), piece.tolist(), strict=True)) == sorted(want)
    assert lengths.tolist() == [5, 2, 4]


def test_a_match_costs_a_few_numbers():
    lattice, words = Lattice(PIECES), ["ab" * 20] * 2000
    lattice.edges(words[:2])
    tracemalloc.start()
    matches = len(lattice.edges(words)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert matches > 150_000 and peak < 120 * matches
