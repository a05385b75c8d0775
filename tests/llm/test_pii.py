import numpy as np
import pytest

from threadloom.llm import pii
from threadloom.llm.pii_table import labelled_table


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.train())


def test_held_out_carriers():
    """Sentences, as well as fillers, that the model has not been trained on."""
    finder = pii.Finder(pii.train(part="train"))
    table = labelled_table(seed=991, per_kind=100, neutral=500, part="held")
    hit = extra = missed = 0
    for (_, spans), found in zip(table, finder.find([t for t, _ in table])):
        want, got = {k for *_, k in spans}, {k for *_, k in found}
        hit, extra, missed = hit + len(want & got), extra + len(got - want), missed + len(want - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.9


def test_parts_share_no_carrier():
    from threadloom.llm import pii_table

    for xs in pii_table.CARRIERS.values():
        train, held = pii_table._part(xs, "train"), pii_table._part(xs, "held")
        assert len(train) + len(held) == len(xs) and len(held) >= 4


def test_viterbi_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    scores, moves, first = (rng.normal(size=s).astype(np.float32) for s in ((4, 4, pii.N), (pii.N, pii.N), (pii.N,)))
    real = np.array([[True] * n + [False] * (4 - n) for n in (1, 2, 3, 4)])
    got = pii.viterbi(scores, real, moves, first)
    for i, n in enumerate((1, 2, 3)):
        best = max(product(range(pii.N), repeat=n), key=lambda p: first[p[0]] + sum(scores[i, t, x] for t, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[i, :n]) == best and not got[i, n:].any()


def test_redaction(finder):
    texts = ["Mail me: anna.berg@example.org, please. The cache is slow.", "", "  ", "Call me on +1 202-555-0143 after six.", "The sensor was built with 12345678.", "x" * 200_000]
    found = finder.find(texts)
    assert pii.redact(texts[0], found[0]) == "Mail me: [EMAIL], please. The cache is slow."
    assert pii.redact(texts[3], found[3]) == "Call me on [PHONE] after six."
    assert [found[i] for i in (1, 2, 4, 5)] == [[], [], [], []]


def test_records(make):
    text = "I met Ingrid Velbrook at the desk and we fixed it."
    posts = make["posts"](dict(id="1", post_type_id="1", body=f"<p>{text}</p>"), dict(id="1", post_type_id="1", body=f"<p>{text}</p>"), dict(id="2", post_type_id="2"), dict(id=None, body=text))
    comments = make["comments"](dict(id="5", text="Ring 415 555 0123 and ask for the night shift."), dict(id="6", text=""), dict(id="7"))
    assert sorted(tuple(r) for r in pii.found(posts, comments).collect()) == [("comments", 5, "phone"), ("posts", 1, "name")]
    out = {r["record_id"]: r["text"] for r in pii.redacted(posts, comments).collect()}
    assert out == {1: "I met [NAME] at the desk and we fixed it.", 5: "Ring [PHONE] and ask for the night shift.", 6: ""}
    assert pii.found(posts.where("false"), comments.where("false")).count() == 0


def test_items_of_a_very_long_line(finder):
    """A line of several thousand tokens, all of it dense in items, is decoded as its parts are."""
    items = [f"anna.berg{i}@example.org" for i in range(10, 600)]
    for lead in ("", "a ", "a b "):
        text = lead + ", ".join(items)
        (found,) = finder.find([text])
        assert [text[a:b] for a, b, kind in found if kind == "email"] == items and "@" not in pii.redact(text, found)
