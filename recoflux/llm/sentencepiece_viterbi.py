"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

A text is marked (each space becomes U+2581, one more leads) and cut before each run of marks, where no piece can cross. The distinct
words that a task has not met are sorted, which walks their trie depth-first: the forward scores of a word are those of the word before it as
far as the two agree, and only the rest is computed. With a unigram model's log probabilities the best sum of scores wins, a longer last piece on
ties. A merge model has no such scores, but merging leaves just one path on which all neighbours stay apart when they alone are merged; so there a step
scores 0 if its two pieces stay apart and minus infinity if not, and the one finite path is the merge order's own result (Merges).
Characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 400_000  # words that a worker remembers; beyond, it forgets all and starts anew
CACHE_CHARS = 48  # longer words are not remembered
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Vocabulary:
    """Pieces by their last character first, as a trie of dicts; '' holds (id, score)."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.ends: dict = {}
        self.pieces, self.bytes, self.number, low = [], {}, {}, 0.0
        # ranks are whole numbers down from 0; log probabilities are not
        scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
        ranks = all(s <= 0 and s == int(s) for s in scores)
        for i, score in enumerate(scores):
            piece, score = sp.id_to_piece(i), -math.log1p(-score) if ranks else score
            self.pieces.append(piece)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"the piece {piece!r} crosses words")
                low = min(low, score)
                self.number[piece] = i
                node = self.ends
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = (i, score)
        self.unknown, self.unknown_id = low - 10.0, sp.unk_id()
        self.kind = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def encode_sorted(self, words: Sequence[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of each word; fastest when words are sorted."""
        best: list[float] = [0.0]
        back: list[tuple[int, int]] = [(0, 0)]
        before, ends, unknown = "", self.ends, self.unknown
        for w in words:
            same = 0
            for x, y in zip(before, w):  # noqa: B905
                if x != y:
                    break
                same += 1
            del best[same + 1 :], back[same + 1 :]
            for e in range(same, len(w)):
                node, j, top, at = ends, e, None, None
                while j >= 0 and (node := node.get(w[j])) is not None:
                    if (hit := node.get("")) is not None:
                        s = best[j] + hit[1]
                        if top is None or s >= top:
                            top, at = s, (j, hit[0])
                    elif j == e:
                        top, at = best[e] + unknown, (e, -1)
                    j -= 1
                if j == e:  # no piece ends in this character
                    top, at = best[e] + unknown, (e, -1)
                best.append(top)
                back.append(at)
            before, ids, e = w, [], len(w)
            while e:
                j, i = back[e]
                ids += reversed([self.bytes.get(b, self.unknown_id) for b in w[j:e].encode()]) if i < 0 and self.bytes else [self.unknown_id if i < 0 else i]
                e = j
            yield w, ids[::-1]

    def decode(self, ids: Sequence[int]) -> str:
        """The text; the leading mark's space goes."""
        kind = self.kind
        return b"".join([kind[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


class Merges(Vocabulary):
    """A merge model: ids as its merges give them, pair by pair of the best score, the leftmost on ties."""

    def __init__(self, proto: bytes):
        super().__init__(proto)
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.rank = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.apart: dict[str, dict[str, bool]] = {}  # piece -> piece before it ('': none) -> whether they stay two

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text."""
        out, rank = list(text), self.rank
        while len(out) > 1:
            best = max(range(len(out) - 1), key=lambda i: (rank.get(out[i] + out[i + 1], -math.inf), -i))
            if out[best] + out[best + 1] not in rank:
                break
            out[best : best + 2] = [out[best] + out[best + 1]]
        return out

    def _stays(self, before: str, piece: str) -> bool:
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def encode_sorted(self, words: Sequence[str]) -> Iterator[tuple[str, list[int]]]:
        back: list[tuple[int, int, str]] = [(0, 0, "")]  # of each prefix: where its last piece begins, its id, the piece
        last, ends, apart = "", self.ends, self.apart
        for w in words:
            same = 0
            for x, y in zip(last, w):  # noqa: B905
                if x != y:
                    break
                same += 1
            del back[same + 1 :]
            for e in range(same, len(w)):
                node, j, found = ends, e, None
                while j >= 0:
                    node = node.get(w[j])
                    hit = node.get("") if node is not None else None
                    if hit is not None or j == e:
                        piece, before = w[j : e + 1], back[j][2] if back[j] else None
                        known = apart.get(piece)
                        if known is None:
                            known = apart[piece] = {}
                        if before is not None:
                            ok = known.get(before)
                            if ok is None:
                                ok = self._stays(before, piece)
                                known[before] = ok
                            if ok:
                                found = (j, hit[0] if hit is not None else -1, piece)
                                break
                    if node is None:
                        break
                    j -= 1
                back.append(found)
            last, ids, e = w, [], len(w)
            if back[e] is None:  # pieces that no merges reach in order
                parts = self.merged(w)
            else:
                parts = []
                while e:
                    parts.append(back[e][2])
                    e = back[e][0]
                parts.reverse()
            for p in parts:
                i = self.number.get(p)
                ids += [i] if i is not None else [self.bytes.get(b, self.unknown_id) for b in p.encode()] if self.bytes else [self.unknown_id]
            yield w, ids


def vocabulary_of(proto: bytes) -> Vocabulary:
    """Merges for a merge model, whose scores are ranks: whole numbers down from 0."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    probe = " \ufb01  a "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model normalises texts")
    scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
    return (Merges if all(s <= 0 and s == int(s) for s in scores) else Vocabulary)(proto)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes; a null or empty text has none."""
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        new = {w for ws in cut for w in ws}
        new.difference_update(known)
        here = {}
        for w, ids in self.vocabulary.encode_sorted(sorted(new)):
            (known if len(w) <= CACHE_CHARS else here)[w] = np.array(ids, np.int32).tobytes()
        if here:
            known = known | here if len(here) * 4 > len(known) else _Both(here, known)
        return [b"".join([known[w] for w in ws]) for ws in cut]


class _Both:
    def __init__(self, a: dict, b: dict):
        self.a, self.b = a, b

    def __getitem__(self, w: str) -> bytes:
        return self.b[w] if w in self.b else self.a[w]


_workers: dict[str, Encoder] = {}


def _encoder(proto: bytes) -> Encoder:
    """The worker's encoder for this model, kept from task to task."""
    key = hashlib.sha256(proto).hexdigest()
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(vocabulary_of(proto))
    return _workers[key]


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, with_tokens: bool = True) -> DataFrame:
    """The columns of docs but text (n_tokens and the like replaced), with n_tokens, n_byte_tokens, tokens (if asked for), ids_sha256 (of int32 little-endian ids) and
    round_trip: whether decoding gives the text back, U+2581 counting as the space that it decodes to. Ids are the library's own for a merge model and
    for a unigram model (but for ties) that normalises nothing; other normalisers are refused.

    docs: doc_id, text, further columns stay. The model is read by the driver and sent with the tasks. A null or empty text has no
    token and round-trips. Repeated rows stay; an empty table gives an empty result.
    """
    proto = docs.sparkSession.sparkContext.broadcast(load(model))
    made = ("n_tokens", "n_byte_tokens", "tokens", "ids_sha256", "round_trip")
    rest = [c for c in docs.columns if c != "text" and c not in made]
    source = docs.select(*(F.col(f"`{c}`") for c in rest), "text")
    names = [c for c in made if with_tokens or c != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(proto.value)
        vocabulary = encoder.vocabulary
        is_byte = np.zeros(len(vocabulary.pieces), bool)
        is_byte[list(vocabulary.bytes.values())] = True
        for batch in batches:
            column = batch.column(len(rest))
            for a, b, _, _ in C.pieces(column):
                texts = column.slice(a, b - a).to_pylist()
                ids = encoder.encode(texts)
                numbers = [np.frombuffer(x, np.int32) for x in ids]
                back = [vocabulary.decode(x.tolist()) == (t or "").replace(MARK, " ") for x, t in zip(numbers, texts, strict=True)]
                columns = {"n_tokens": pa.array([len(x) for x in numbers], pa.int64()), "n_byte_tokens": pa.array([int(is_byte[x].sum()) for x in numbers], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), "round_trip": pa.array(back, pa.bool_())}
                if with_tokens:
                    columns["tokens"] = pa.array(numbers, pa.list_(pa.int32()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *(columns[c] for c in names)], names=[*rest, *names])

    kinds = {"n_tokens": T.LongType(), "n_byte_tokens": T.LongType(), "tokens": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "round_trip": T.BooleanType()}
    schema = source.schema
    out = type(schema)(schema.fields[: len(rest)])
    for c in names:
        out = out.add(c, kinds[c])
    return source.mapInArrow(C.lean(run), out)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of doc_id, tokens; null tokens give a null text."""
    proto = tokens.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(proto.value).vocabulary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "tokens").mapInArrow(run, "doc_id long, text string")
