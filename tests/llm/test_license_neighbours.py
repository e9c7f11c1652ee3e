"""Notices that stand next to each other in one block."""

import itertools

from runledger.llm import licenses

SHORT = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts if len(text.split()) <= 12]
PROSE = "the river ran past the old mill and nobody spoke about it for years "


def scanner():
    return licenses.Scanner(licenses.TEMPLATES, 0.3, 0.8)


def test_neighbours_do_not_hide_a_short_notice():
    scan = scanner()
    for (one, a), (two, b) in itertools.permutations(SHORT, 2):
        for gap in (" ", f" {PROSE}"):
            got = scan(f"{PROSE}{a}{gap}{b} {PROSE}")
            assert [(f["license"], f["similarity"]) for f in got] == [(one, 1.0), (two, 1.0)], (a, b, gap)
