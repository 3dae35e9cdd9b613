"""Substring removal by prefix-partitioned suffix trees over words.

Candidate suffixes (see repeats: their windows' cores, sequences of words, partition them into memory-sized groups) are put
into subtrees by variable-length prefixes: a group of suffixes is split by its next few words, the range growing as groups
shrink; a group of one is a leaf and is dropped, and what is left `window` words deep are internal nodes, the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from . import repeats as R

WINDOW = 35


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Those of the suffixes `starts` of words that meet another one in a node at least `depth` words deep."""
    node = np.zeros(len(starts), np.int64)
    at, step = 0, 1
    while at < depth and len(starts):
        step = min(step, depth - at)
        order = np.lexsort([words[starts + at + j] for j in reversed(range(step))] + [node])
        starts, node = starts[order], node[order]
        new = np.ones(len(starts), bool)
        new[1:] = node[1:] != node[:-1]
        for j in range(step):
            w = words[starts + at + j]
            new[1:] |= w[1:] != w[:-1]
        node = np.cumsum(new) - 1
        keep = np.bincount(node)[node] > 1
        starts, node = starts[keep], node[keep]
        at, step = at + step, step * 2
    return starts


def repeated_in_shard(stretches: list[bytes], window: int = WINDOW) -> dict[int, list[tuple[int, int]]]:
    """Runs of starts, by stretch, of windows that start at two places or more of the shard."""
    words = np.frombuffer(b"".join(stretches), C.U64)
    size = np.array([len(x) // 8 for x in stretches])
    begin = np.cumsum(size) - size
    start = np.sort(deep_nodes(words, C.ranges(begin, size - window + 1), window))
    which = np.searchsorted(begin, start, "right") - 1
    out: dict[int, list[tuple[int, int]]] = {}
    if len(start):
        cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(which) != 0)) + 1
        for a, b in zip([0, *cut], [*cut, len(start)], strict=True):
            i = int(which[a])
            out.setdefault(i, []).append((int(start[a] - begin[i]), int(start[b - 1] - begin[i])))
    return out


def _word_units(raw: np.ndarray, offsets: np.ndarray):
    starts, ends, at = C.word_spans(raw, offsets)
    h = C.word_hashes(raw, starts, ends)
    return h | C.U64(1), at, h


def cut_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, copied, marks = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            rows = []
            for a, b, raw, offsets in C.pieces(batch.column(2)):
                starts, ends, at = C.word_spans(raw, offsets)
                data = raw.tobytes()
                for i in range(a, b):
                    lo, hi = int(at[i - a]), int(at[i - a + 1])
                    n = hi - lo
                    runs = [(0, n)] if copied[i] and n >= window else R.covered(marks[i], window)
                    if not runs:
                        kept = [x for x in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                    else:
                        stay = np.ones(n, bool)
                        for x, y in runs:
                            stay[x:y] = False
                        kept = list(zip(starts[lo:hi][stay].tolist(), ends[lo:hi][stay].tolist(), strict=True))
                    digest = hashlib.sha256(b" ".join([data[x:y] for x, y in kept])).hexdigest()
                    rows.append((k1[i], k2[i], n, sum(y - x for x, y in runs), digest, [{"first": x, "last": y} for x, y in runs]))
            yield pa.RecordBatch.from_pylist([dict(zip(CUT.names, r, strict=True)) for r in rows], CUT)

    return run


CUT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes every word covered by a window of `window` words whose sequence also starts anywhere else in the corpus.

    docs: doc_id, text (other columns are ignored). Returns, for each row of docs, doc_id, n_words, n_removed, kept_sha256 and spans
    (the removed word runs, last exclusive). Words are runs without ASCII white space; a null, empty or blank text has none. Rows with one
    text, repeated rows included, are copies of each other. A null doc_id stays. An empty table gives an empty result.
    """
    gram = min(8, window)
    reach = window - gram + 1
    plan = R.Plan(window, gram, max(1, -(-reach // 2)), max(1, -(-reach // 14)), _word_units, lambda s: repeated_in_shard(s, window), shard_units=1 << 20)
    return R.remove_repeats(docs.select("doc_id", "text"), plan, 8, cut_words(window), "n_words long, n_removed long, kept_sha256 string, spans array<struct<first: long, last: long>>")
