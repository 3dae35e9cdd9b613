"""N-gram Jaccard join against all pairs."""

import random
import re

import pytest

from recoflux.llm import ngram_join as N

TEXT = "doc_id long, text string"


def shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near(r, t, n):
    w = t.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = "w" + str(r.randrange(10**6))
    return " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice(["Aa", "bé", "c", "Dd", "e"]) + str(r.randrange(60)) for _ in range(k))
    texts = [some(r.randint(0, 90)) for _ in range(60)]
    line = some(30)
    for _ in range(60):
        t = r.choice(texts[:30])
        texts.append(near(r, t, r.randint(0, 5)) if t else "")
    base = some(120)
    texts += [near(r, base, r.randint(1, 3)) for _ in range(60)] + [f"{line} {some(r.randint(3, 12))}" for _ in range(25)]
    texts += [texts[0].upper(), "One two", "one  TWO", "a b c d e", "a b c d e f", "a b c d e f", None, "", " "]
    return list(enumerate(texts))


@pytest.mark.parametrize("dense,frequent,block", [(16, None, 4096), (16, 1, 7), (3, 1, 4096), (64, 2, 4096)])
def test_against_all_pairs(spark, monkeypatch, dense, frequent, block):
    rows = corpus(dense)
    monkeypatch.setattr(N, "DENSE", dense)
    monkeypatch.setattr(N, "BLOCK", block)
    if frequent is not None:
        keys = N._index
        monkeypatch.setattr(N, "_index", lambda sketch, _, parts: keys(sketch, frequent, parts))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_join(spark.createDataFrame(rows, TEXT)).collect())
    assert got == brute(rows)


def test_odd_tables(spark):
    assert N.ngram_join(spark.createDataFrame([], TEXT)).collect() == []
    t = "x y z u v w"
    rows = [(None, t), (3, t), (3, t), (7, t), (9, None), (None, None)]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], TEXT + ", node int, key string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in N.ngram_join(df).collect())
    assert got == [(-1, 0, -1), (-1, 2, 3), (3, 2, 3), (3, 2, 3), (7, 2, 3), (9, 0, 9)]
    kept = N.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "3", "9", "None", "None"] and kept[0].key == "k"
