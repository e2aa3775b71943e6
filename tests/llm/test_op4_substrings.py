import pytest

from cartulary.llm import substrings


def brute(docs, window):
    """First doc_id of each window; a word goes if a window over it has a smaller one."""
    least: dict[tuple, int] = {}
    split = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None and (k not in least or d < least[k]):
                least[k] = d
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_equal_windows_share_an_aligned_anchor():
    span = substrings.WINDOW - substrings.PERIOD + 1
    for i in range(60):
        for j in range(60):
            a, b = (set(substrings.anchor_positions(400)) for _ in range(2))
            assert any(i + k in a and j + k in b and k + span <= substrings.WINDOW for k in range(substrings.PERIOD))


@pytest.mark.parametrize("window", [50, 40])
def test_against_brute_force(messy, window):
    docs = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    got = substrings.remove_repeats(messy, window=window).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=repr) == brute(docs, window)


def test_empty_table(empty):
    assert substrings.remove_repeats(empty).count() == 0
