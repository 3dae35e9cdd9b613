"""Suffix-array and substring removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from recoflux.llm import suffix_array as SA
from recoflux.llm import suffix_tree as ST

TEXT = "doc_id long, text string"


def brute(texts, units, window, join):
    seqs = [units(t or "") for t in texts]
    count = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if count[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(s), sum(gone), runs, hashlib.sha256(join([x for x, g in zip(s, gone) if not g])).hexdigest()))
    return out


def corpus(n=60, seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    some = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [some(120) for _ in range(3)]
    texts = []
    for i in range(n):
        t = some(r.randint(0, 150))
        if i % 3 == 0:
            t += r.choice([" ", "\n"]) + r.choice(shared) + "\t" + some(10)
        if i % 7 == 0 and texts:
            w = r.choice(texts[: max(1, i // 2)] or [""]) or ""
            t = w.replace(" ", "  ", 1) if i % 2 else w[: len(w) // 2] + some(1) + w[len(w) // 2 :]
        texts.append(t)
    return [*texts, "", None, " \n ", texts[3], texts[3], "x" * 900, "ab " * 400, shared[0], "zu\0 null" * 80]


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_suffix_array_sorts(n):
    r = np.random.default_rng(n)
    for top in (2, 5, 200):
        t = np.append(r.integers(1, top + 1, n), 0).astype(np.uint8)
        t[r.integers(0, n // 3 + 1, n // 20) * 3 - 3] = 0  # no two separators in a row
        b = t.tobytes()
        assert SA.suffix_array(t, n + 2).tolist() == sorted(range(n + 1), key=lambda i: b[i:])


def test_bytes_against_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in SA.suffix_array_dedup(spark.createDataFrame(list(enumerate(texts)), TEXT)).collect()}
    want = brute(texts, lambda t: list(t.encode()), 400, bytes)
    assert got == dict(enumerate(want)) and any(w[1] for w in want)


def test_words_against_brute_force(spark):
    texts = corpus(seed=8)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in ST.substring_dedup(spark.createDataFrame(list(enumerate(texts)), TEXT)).collect()}
    want = brute(texts, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 35, lambda ws: " ".join(ws).encode())
    assert got == {i: (a, b, d) for i, (a, b, _, d) in enumerate(want)} and any(w[1] for w in want)


@pytest.mark.parametrize("op", [SA.suffix_array_dedup, ST.substring_dedup])
def test_odd_tables(spark, op):
    assert op(spark.createDataFrame([], TEXT)).collect() == []
    t = "word " * 200
    df = spark.createDataFrame([(None, t, 1, "a"), (1, t, 2, None), (1, t, 2, None), (2, None, None, "b")], TEXT + ", k1 int, marks string")
    rows = sorted(op(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in rows] == [None, 1, 1, 2]
    assert [r.n_removed == r[1] for r in rows] == [True, True, True, True] and rows[3][1] == 0


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_cores_are_split(spark, hot):
    from dataclasses import replace

    from recoflux.llm import repeats as R

    texts = [t or "" for t in corpus(seed=11)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(dict.fromkeys(texts))], "k1 long, k2 long, text string")
    for plan, size in ((R.Plan(400, 32, 123, 8, SA._byte_units, SA.repeated_in_shard), 1), (R.Plan(35, 8, 14, 2, ST._word_units, ST.repeated_in_shard), 8)):
        def starts(p):
            return sorted({(r.k1, i) for r in R.repeated_starts(df, p, size).collect() for i in range(r.first, r["last"] + 1)})
        assert starts(replace(plan, hot=hot, shard_units=2000)) == starts(plan) != []


def test_hot_cores_lose_no_window_at_class_borders(spark):
    """A passage at several offsets behind other bytes, with `hot` between the counts of neighbouring cores."""
    from dataclasses import replace

    from recoflux.llm import repeats as R

    r = random.Random(2)
    some = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    passage = some(1000)
    texts = [some(300) + passage[cut:] + some(300) for cut in range(0, 300, 3)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "k1 long, k2 long, text string")
    plan = R.Plan(400, 32, 123, 8, SA._byte_units, SA.repeated_in_shard)
    want = {(i, 300 + j) for i, cut in enumerate(range(0, 300, 3)) for j in range(1000 - cut - 399) if i or j >= 3}
    for hot in (0, 30, 60, 97):
        rows = R.repeated_starts(df, replace(plan, hot=hot), 1).collect()
        assert want - {(x.k1, i) for x in rows for i in range(x.first, x["last"] + 1)} == set(), hot


def test_suffix_array_sorts_substrings_of_whole_chunks():
    """A leftmost-smaller substring of eight symbols (a chunk) against a longer one that it begins."""
    r = random.Random(4)
    for _ in range(20):
        b = b"".join(r.choice([b"zbdfhgfcbc", b"zbdfhgfcba", b"zbdfhgfcbcc", b"zq"]) for _ in range(60)) + b"\0"
        t = np.frombuffer(b, np.uint8)
        assert SA.suffix_array(t, len(t)).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
