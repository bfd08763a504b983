"""Packs stay full when one short length is very common."""

import collections

import pytest

from loomgrid.llm import packing


def one_by_one(hist, limit):
    """The rooms of the packs if each piece goes into the pack with the most room, longest first."""
    rooms = []
    for n in sorted(hist, reverse=True):
        for _ in range(hist[n]):
            k = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if k is None or rooms[k] < n:
                rooms.append(limit)
                k = len(rooms) - 1
            rooms[k] -= n
    return sorted(rooms)


HISTOGRAMS = [{100: 1_000_000}, {**dict.fromkeys(range(50, 2000), 20), 120: 20_000}, {**dict.fromkeys(range(300, 4000), 1), 300: 40_000}]


@pytest.mark.parametrize("hist", HISTOGRAMS)
def test_hot_length_fills_packs(hist):
    patterns, used = packing.packing_patterns(hist, 4096), collections.Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 4096
        for n in lengths:
            used[n] += count
    total, packs = sum(n * c for n, c in hist.items()), sum(count for count, _ in patterns)
    print(packs, total / (packs * 4096))
    assert used == hist and total > 0.93 * packs * 4096


@pytest.mark.parametrize("hist", [{7: 40, 3: 50, 2: 9}, {16: 3, 5: 31, 4: 1, 1: 40}, {9: 4, 8: 3, 1: 100}])
def test_bulk_equals_one_by_one(hist):
    got = [16 - sum(lengths) for count, lengths in packing.packing_patterns(hist, 16) for _ in range(count)]
    assert sorted(got) == one_by_one(hist, 16)
