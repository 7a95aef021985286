"""Repeated passages against brute force over all windows."""

import random
import re

import numpy as np
import pytest

from rankforge.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=20):
    """rows have different ids, or equal texts."""
    texts = {i if i is not None else substrings.LAST: WORD.findall(t or "") for i, t in rows}
    seen, gone = set(), {}
    for i in sorted(texts):
        w, cut = texts[i], set()
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen:
                cut.update(range(k, k + width))
            seen.add(x)
        gone[i] = cut
    out = []
    for i, _ in rows:
        key = i if i is not None else substrings.LAST
        out.append((i, len(texts[key]), len(gone[key]), " ".join(x for k, x in enumerate(texts[key]) if k not in gone[key])))
    return sorted(out, key=repr)


def passages(seed, n):
    rng = random.Random(seed)
    shared = [" ".join(f"s{rng.randrange(900)}" for _ in range(rng.randrange(15, 70))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(3)):
            t += [rng.choice(shared), " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(0, 9)))]
        if rng.random() < 0.15 and out:
            t = [rng.choice(out)]
        if rng.random() < 0.1:
            t.append(" ".join(["no"] * rng.randrange(10, 60)))
        if rng.random() < 0.1:
            t.append("\n".join(["one line that comes again"] * rng.randrange(2, 12)))
        out.append(" ".join(t))
    return out


def rows_of(spark, rows, width=20, parts=4):
    d = spark.createDataFrame([(i, t, -1, "kept", "x") for i, t in rows], "doc_id long, text string, n_words int, kept string, oid string").repartition(parts)
    return sorted((tuple(r) for r in substrings.drop_repeats(d, width).collect()), key=repr)


def test_repeats_equal_brute_force(spark):
    rows = list(enumerate(passages(5, 400)))
    assert rows_of(spark, rows) == brute(rows)


@pytest.mark.parametrize("width", [1, 2, 7])
def test_other_widths(spark, width):
    rows = list(enumerate(passages(6, 60)))
    assert rows_of(spark, rows, width) == brute(rows, width)


def test_groups_split_by_longer_prefixes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 16)
    monkeypatch.setattr(substrings, "COUNTERS", 8)
    monkeypatch.setattr(substrings, "HELD", 64)
    rows = list(enumerate(passages(7, 150)))
    assert rows_of(spark, rows) == brute(rows)


def test_odd_rows(spark):
    p = " ".join(f"p{i}" for i in range(25))
    rows = [(None, p), (9, p), (9, p), (1, None), (2, ""), (3, " \n\t "), (4, "x " * 45), (5, p.upper()), (6, " ".join(f"p{i}" for i in range(19))), (7, p.replace(" ", "\n\t")), (8, "z " + " ".join(f"q{i % 3001}" for i in range(20000)))]
    got = rows_of(spark, rows)
    assert got == brute(rows) and [r for r in got if r[0] == 9][0][2] == 25 and [r for r in got if r[0] == 7][0][2] == 0
    assert rows_of(spark, []) == []
    two = [(1, p), (1, p + " end")]
    assert sorted(r[2] for r in rows_of(spark, two)) in ([0, 25], [0, 25])


def test_tree_nodes_are_shared_prefixes():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (300, 4))
    rows = np.zeros(300, substrings.record(4))
    key = np.zeros((300, 12), np.uint8)
    key[:, :4] = words
    key[:, 4:] = (words @ np.array([27, 9, 3, 1])).astype(np.uint64).view(np.uint8).reshape(300, 8)
    rows["key"], rows["place"] = key.view("V12").ravel(), np.arange(300)
    tree = substrings.Tree(rows, 4)
    for depth in (1, 2, 3, 4):
        first, end = tree.nodes(depth)
        got = sorted(tuple(sorted(tree.leaves["place"][a:b].tolist())) for a, b in zip(first, end))
        want = {}
        for i, w in enumerate(words):
            want.setdefault(tuple(w[:depth]), []).append(i)
        assert got == sorted(tuple(v) for v in want.values() if len(v) > 1)
