"""Viterbi against every cut, and exact round trips."""

import functools
import hashlib
import math
import random

import numpy as np
import pytest
import sentencepiece

from recoflux.llm import sentencepiece_viterbi as V


WORDS = ["the", "Straße", "naïve", "don't", "1234", "x=y;", "日本語", "🙂", "\n", "\t", "", "", "aaaa", "thththth", "Zürich", "ñandú", "[[]]", "<s>", "<0x41>", "internationalization"]


@pytest.fixture(scope="module")
def vocabulary():
    return V.Vocabulary(V.load())


def texts():
    r = random.Random(3)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 12))) for _ in range(300)] + ["", " ", "  a", "a  ", "x" * 50, "\0"]


def best(word, pieces, unknown):
    """The best sum over every way to cut a word, by recursion from its end."""

    @functools.cache
    def go(e):
        if not e:
            return 0.0
        cuts = [go(j) + pieces[word[j:e]] for j in range(e) if word[j:e] in pieces]
        return max([*cuts, *([go(e - 1) + unknown] if word[e - 1] not in pieces else [])])

    return go(len(word))


def test_best_cut(vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_proto=V.load())
    pieces = {sp.id_to_piece(i): -math.log1p(-sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    words = sorted({"▁" + w + x for w in WORDS for x in (*WORDS, "")})
    for w, ids in vocabulary.encode_sorted(words):
        got = [vocabulary.pieces[i] for i in ids]
        loose = sum(len(c.encode()) > 0 and c not in pieces for c in w)
        whole = [p for p, i in zip(got, ids, strict=True) if not sp.is_byte(i)]
        assert sum(pieces[p] for p in whole) + loose * vocabulary.unknown == pytest.approx(best(w, pieces, vocabulary.unknown)), w


def test_words_of_the_merge_vocabulary_stay_whole(vocabulary):
    assert [[vocabulary.pieces[i] for i in ids] for _, ids in vocabulary.encode_sorted(["▁and", "▁of", "▁the"])] == [["▁and"], ["▁of"], ["▁the"]]


def test_round_trip(vocabulary):
    v = vocabulary
    for t, ids in zip(texts(), V.Encoder(v).encode(texts()), strict=True):
        assert v.decode(np.frombuffer(ids, np.int32).tolist()) == t


def test_prefix_sharing_changes_nothing(vocabulary):
    v = vocabulary
    words = sorted({"▁" + w * k for w in WORDS for k in (1, 2, 3)})
    assert dict(v.encode_sorted(words)) == {w: next(v.encode_sorted([w]))[1] for w in words}


def test_tables(spark):
    rows = [(1, "one two", 5), (1, "one two", 5), (None, None, 6), (2, "", 7), (3, "a▁b " * 3, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = V.encode(df).collect()
    assert [r.n_tokens > 0 for r in got] == [True, True, False, False, True] and all(r.round_trip for r in got)
    assert got[2].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[0].ids_sha256 == got[1].ids_sha256
    assert [r.text for r in V.decode(V.encode(df)).collect()] == ["one two", "one two", "", "", "a b " * 3]
    assert V.encode(df.limit(0)).collect() == []


def test_query_and_pipeline_return_tokens(spark, tmp_path):
    import corpus_pipeline
    from recoflux.llm import queries

    docs = spark.createDataFrame([(1, "the river and the hill"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for made in (queries.op4_sentencepiece(spark, str(tmp_path)), corpus_pipeline.STAGES[-1][1](spark, docs, "")):
        rows = {r.doc_id: r for r in made.collect()}
        assert hashlib.sha256(np.array(rows[1].tokens, np.int32).tobytes()).hexdigest() == rows[1].ids_sha256
        assert len(rows[1].tokens) == rows[1].n_tokens > 0 and rows[2].tokens == []


def test_ids_are_the_library_s():
    sp, v = sentencepiece.SentencePieceProcessor(model_proto=V.load()), V.vocabulary_of(V.load())
    assert isinstance(v, V.Merges)
    r = random.Random(5)
    odd = ["".join(r.choice("▁▁ab the in ercountry\n\té日本🙂0123.,s ") for _ in range(r.randint(1, 80))) for _ in range(2000)]
    many = [*texts(), *odd, *("▁" * k + "the" for k in range(40)), *(" " * k for k in range(1, 40)), "a" * 3000, "internationalization" * 50]
    got = [np.frombuffer(x, np.int32).tolist() for x in V.Encoder(v).encode(many)]
    assert got == sp.encode(many)


def test_unigram_ids_are_the_library_s():
    """The same pieces with log probabilities, as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(V.load())
    model.trainer_spec.model_type = 1
    r = random.Random(6)
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -math.log1p(i) - r.random()
    proto = model.SerializeToString()
    sp, v = sentencepiece.SentencePieceProcessor(model_proto=proto), V.vocabulary_of(proto)
    assert not isinstance(v, V.Merges)
    got = [np.frombuffer(x, np.int32).tolist() for x in V.Encoder(v).encode(texts())]
    want = sp.encode(texts())
    assert sum(a != b for a, b in zip(got, want, strict=True)) == 0


def test_models_that_normalise_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(V.load())
    model.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        V.vocabulary_of(model.SerializeToString())
