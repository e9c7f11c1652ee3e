"""License windows: every template at every place, one finding a notice, whatever stands round it."""

import random

import pytest

from runledger.llm import licenses

EXACT = [(name, t) for name, texts in licenses.TEMPLATES.items() for t in texts]
WORDS = "the of and license terms under river mill copyright any use permission software old free".split()


def everywhere(scan, text):
    """Findings from every template at every word, as if hints were not known."""
    words = [m.span() for m in licenses.WORD.finditer(text)]
    starts = {i: set(range(-len(t[1]), len(words))) for i, t in enumerate(scan.templates)}
    return scan.confirm(text, words, scan.reductions(text, words, starts))


@pytest.mark.parametrize("seed", range(6))
def test_hints_lose_nothing_that_every_window_finds(seed):
    rng, scan = random.Random(seed), licenses.Scanner(licenses.TEMPLATES, 0.3, 0.8)
    parts = []
    for _ in range(4):
        parts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40))))
        name, text = rng.choice(EXACT)
        own = text.split()
        if len(own) > 12:
            own[rng.randrange(len(own))] = "other"
        parts.append(" ".join(own))
    text = "\n".join(parts)
    got = [(f["license"], f["start"], f["end"], f["similarity"]) for f in scan(text)]
    assert got == [(f[0], f[1], f[2], f[4]) for f in everywhere(scan, text)]
    assert len(got) >= 4


def test_a_notice_counts_once_at_every_place_of_a_text_full_of_hints():
    scan = licenses.Scanner(licenses.TEMPLATES, 0.3, 0.8)
    dense = "some license or copyright words with permission to redistribute here and there "
    for k in range(0, 200, 7):
        got = scan(dense * k + "Licensed under the ISC License. " + dense * (200 - k))
        assert [(f["license"], f["similarity"]) for f in got] == [("ISC", 1.0)], k


def test_every_template_is_found_alone_and_by_its_own_name():
    scan = licenses.Scanner(licenses.TEMPLATES, 0.3, 0.8)
    for name, text in EXACT:
        got = scan(f"before it {text} behind it")
        assert [(f["license"], f["similarity"], f["differences"]) for f in got] == [(name, 1.0, "")], text
    with pytest.raises(ValueError):
        licenses.Scanner({"none": ["no such word"]}, 0.3, 0.8)
    assert scan("") == [] and scan(" \n ") == [] and scan("license") == []
