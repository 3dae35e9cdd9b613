"""run() against a plain version of its five stages."""

import random
import re

import pytest
import sentencepiece

from recoflux.llm import sentencepiece_viterbi as V
from test_ngram_join import shingles
from test_rows import secrets_base

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(400)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [some(16) for _ in range(3)]
    texts = [some(r.randint(25, 90)) for _ in range(30)]
    for t in texts[:6]:
        w = t.split()
        w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [f"{some(20)} {items[0]} {some(20)}", f"{some(30)} {items[1]}", some(5), "SHOUT IT LOUD " * 12, "one line of junk here now\n" * 12, "### $$$ %%% " * 15, None, ""]
    texts += [f"{some(25)} password = Zx9abcdefghij12 {some(10)}", f"{some(25)} deadbeefdeadbeef01 {some(10)}", texts[8], texts[8]]
    return list(enumerate(texts)), list(enumerate(items))


def good(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    caps = sum(len(re.findall("[A-Z]", x)) >= 2 and not re.search("[a-z]", x) for x in w)
    runs = [tuple(w[i : i + 8]) for i in range(n - 7)]
    again = {i + j for i, x in enumerate(runs) if runs.count(x) > 1 for j in range(8)}
    bad = [n < 20, 10 * len(re.findall(r"[#*$%&|<>]", t)) > 2 * n, 2 * n > chars or chars > 25 * n, 100 * caps > 50 * n, 100 * len(re.findall("[!?]", t)) > 60 * n, 100 * dup > 50 * len(lines), 100 * len(again) > 30 * n]
    return not any(bad)


def plain(docs, items):
    docs = [(i, t) for i, t in docs if good(t)]
    sets, up = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    docs = [d for i, d in enumerate(docs) if find(i) == i]
    docs = [(i, t) for i, t in docs if not any(x in t for _, x in items)]
    sp, out = sentencepiece.SentencePieceProcessor(model_proto=V.load()), {}
    for i, t in docs:
        for a, b in sorted((tuple(map(int, x.split(":")[1:])) for x in secrets_base(t).split(",") if x), reverse=True):
            t = t[:a] + "[SECRET]" + t[b:]
        out[i] = (sp.encode(t), len(t))
    return out


@pytest.mark.parametrize("empty", [False, True])
def test_run_against_a_plain_version(spark, tmp_path, empty):
    import corpus_pipeline

    docs, items = corpus()
    docs = [] if empty else docs
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.tokens, r.n_chars) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = plain(docs, items)
    assert got == want and (empty or 25 < len(want) < len(docs) - 10)
