"""Reworded and exact copies of one notice in one block."""

from runledger.llm import licenses


def test_a_reworded_notice_before_an_exact_one_is_found():
    exact = licenses.TEMPLATES["MIT"][3]
    changed = exact.replace("free of charge", "at no cost")
    scan = licenses.Scanner(licenses.TEMPLATES, 0.3, 0.8)
    for texts in ([changed, exact], [exact, changed], [changed, exact, changed]):
        got = scan(" and then ".join(texts))
        assert [f["license"] for f in got] == ["MIT"] * len(texts)
        assert [f["similarity"] == 1.0 for f in got] == [t == exact for t in texts]
