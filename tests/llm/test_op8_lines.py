import pytest

from cartulary.llm import lines

BLANK = " \t\r\x0b\x0c"


def brute(docs, window):
    """In order of (doc_id, text hash): a line goes if a window of lines over it was seen at an earlier place."""
    split = []
    for d, key, t in docs:
        every = (t or "").split("\n") if t is not None else []
        split.append((d, key, t, every, [i for i, x in enumerate(every) if x.strip(BLANK)]))
    first = {}
    for d, key, _, every, at in split:
        for k in range(len(at) - window + 1):
            w = tuple(every[i].strip(BLANK) for i in at[k : k + window])
            if d is not None:
                first[w] = min(first.get(w, (d, key, k)), (d, key, k))
    out = []
    for d, key, t, every, at in split:
        gone = set()
        for k in range(len(at) - window + 1):
            w = tuple(every[i].strip(BLANK) for i in at[k : k + window])
            if d is not None and first[w] < (d, key, k):
                gone.update(at[k : k + window])
        out.append((d, len(at), len(gone), t if not gone else "\n".join(x for i, x in enumerate(every) if i not in gone)))
    return sorted(out, key=repr)


def by_hash(docs):
    return [tuple(r) for r in docs.selectExpr("doc_id", "xxhash64(text)", "text").collect()]


@pytest.mark.parametrize("window", [5, 3, 2, 1])
def test_runs_against_brute_force(messy, window):
    got = lines.remove_lines(messy, window=window, alone=False)
    assert got.columns == [*messy.columns, "__lines", "__removed", "__in_runs", "__alone"]
    assert sorted([(r.doc_id, r["__lines"], r["__removed"], r.text) for r in got.collect()], key=repr) == brute(by_hash(messy), window)


@pytest.mark.parametrize("window", [4, 2])
def test_both_steps_against_brute_force(messy, window):
    """Together they take every line that equals an earlier one; the first step those in runs."""
    got = lines.remove_lines(messy, window=window).collect()
    assert sorted([(r.doc_id, r["__lines"], r["__removed"], r.text) for r in got], key=repr) == brute(by_hash(messy), 1)
    assert sorted((str(r.doc_id), r["__lines"], r["__in_runs"]) for r in got) == sorted((str(d), n, gone) for d, n, gone, _ in brute(by_hash(messy), window))
    assert all(r["__removed"] == r["__in_runs"] + r["__alone"] for r in got) and {True} <= {r["__in_runs"] > 0 for r in got} & {r["__alone"] > 0 for r in got}


def test_equal_windows_select_the_same_line():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        shared = rng.integers(0, 4, 6).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 4, n).astype(np.uint64), shared, rng.integers(0, 4, 5).astype(np.uint64)]) for n in (3, 8))
        x, y = lines.selected(a, 3)[3:7] - 3, lines.selected(b, 3)[8:12] - 8
        assert x.tolist() == y.tolist()


def test_rows_fall_with_the_density(spark):
    """Of lines that are all different about 2 in window + 1 are dealt out, and each window just once."""
    text = "\n".join(f"line {i * 7919 % 5003}" for i in range(5000))
    docs = spark.createDataFrame([(1, 5, text)], "doc_id bigint, tkey bigint, text string")
    for window in (1, 4, 7):
        got = lines.selections(lines.line_hashes(docs), window).collect()
        assert abs(len(got) / 5000 * (window + 1) / 2 - 1) < 0.1
        assert sorted(r.start + k for r in got for k in range(len(r.w0))) == list(range(5000 - window + 1))


def test_empty_table(empty):
    assert lines.remove_lines(empty).count() == 0


def test_a_text_without_repeats_is_kept_byte_for_byte(messy):
    rows = messy.where("doc_id in (706, 708)")
    want = {r.doc_id: r.text for r in rows.collect()}
    assert {r.doc_id: r.text for r in lines.remove_lines(rows).collect()} == want


def test_single_lines_and_pairs_go(spark):
    docs = [(1, "a head\nshared\nits own"), (2, "x\n\n shared \ny"), (3, "shared"), (4, "p\nq"), (5, "p\nq\nnew"), (6, "z\nz")]
    got = lines.remove_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    want = [(1, 3, 0, docs[0][1]), (2, 3, 1, "x\n\ny"), (3, 1, 1, ""), (4, 2, 0, "p\nq"), (5, 3, 2, "new"), (6, 2, 1, "z")]
    assert sorted((r.doc_id, r["__lines"], r["__removed"], r.text) for r in got.collect()) == want


def test_a_run_is_found_by_its_selected_lines(spark):
    """A repeated run of the window's length always goes in the first step, one line less never does."""
    body = [f"line {i}" for i in range(40)]
    docs = [(1, "\n".join(body)), (2, "\n".join(["other", *body[7:11], "another"])), (3, "\n".join(["third", *body[20:23], "fourth"]))]
    got = {r.doc_id: (r["__in_runs"], r["__alone"]) for r in lines.remove_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: (0, 0), 2: (4, 0), 3: (0, 3)}
