"""Leaks by the documented rule: any 120 characters of an item with at most 5 % edits, short items between word borders."""

import random

import numpy as np
import pytest
from netaccess.llm import decontaminate

from .conftest import invented

LONG = decontaminate.normalise(invented(500, 90))[:350].strip()


def least_edits(window, text):
    """Edits of the window against any part of the text, cell by cell."""
    previous = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        row = [i + 1]
        for j, d in enumerate(text):
            row.append(min(previous[j] + (c != d), previous[j + 1] + 1, row[j] + 1))
        previous = row
    return min(previous)


@pytest.mark.parametrize(("start", "end"), [(70, 230), (25, 145), (1, 121), (100, 230), (225, 345)])
def test_passage_off_the_stride(start, end):
    index = decontaminate.WindowIndex([(1, LONG), (2, invented(501, 60))])
    found = index.matches(f"{invented(7, 40)} qqq{LONG[start:end]}zzz {invented(8, 40)}")
    assert set(found) == {1} and found[1][1] == 0


def test_passage_of_under_120_characters_is_no_leak():
    assert not decontaminate.WindowIndex([(1, LONG)]).matches(f"{invented(7, 40)} {'q' * 30}{LONG[70:180]}{'z' * 30} {invented(8, 40)}")


def test_windows_against_full_alignment():
    r = random.Random(11)
    index = decontaminate.WindowIndex([(1, LONG[:150])])
    for trial in range(12):
        leak = list(LONG[12:140])
        for _ in range(trial):
            at, kind = r.randrange(len(leak)), r.randrange(3)
            leak[at : at + 1] = [] if kind == 0 else ["q"] if kind == 1 else [leak[at], "q"]
        text = decontaminate.normalise("zz zzz " * (trial % 3) + "".join(leak) + " zz zzz" * (trial % 2))
        edits = np.array([least_edits(LONG[s : s + 120], text) for s in range(31)])
        want = {1: (int((edits <= 6).sum()), int(edits.min()))} if (edits <= 6).any() else {}
        assert index.matches(text) == want


def test_short_items_inside_texts():
    index = decontaminate.WindowIndex([(1, "Two short words"), (2, "words"), (3, LONG), (4, "words")])
    assert index.matches("Here are two -- short WORDS, again.") == {1: (1, 0), 2: (1, 0), 4: (1, 0)}
    assert index.matches("two short wordsmiths") == {}
    assert set(index.matches("two short words")) == {1, 2, 4}
