"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection share are measured on a sample; rules run by falling rejection per cost, each only on what the
ones before it have kept. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .textstats import BANG, Stats

SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    """rejects: Stats -> bool for each text."""

    name: str
    rejects: Callable[[Stats], np.ndarray]


RULES = (
    Rule("few_words", lambda s: s.n_words < 20),
    Rule("symbols", lambda s: 10 * s.n_symbols() > 2 * s.n_words),
    Rule("word_length", lambda s: (2 * s.n_words > s.word_chars()) | (s.word_chars() > 25 * s.n_words)),
    Rule("capitals", lambda s: 100 * s.caps_words() > 50 * s.n_words),
    Rule("exclamations", lambda s: 100 * s.count(BANG) > 60 * s.n_words),
    Rule("dup_lines", lambda s: 100 * s.lines()[1] > 50 * s.lines()[0]),
    Rule("repeat_words", lambda s: 100 * s.repeat_words() > 30 * s.n_words),
)


def order_rules(texts: Sequence[str | None], rules: Sequence[Rule] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a text, share rejected) by falling rejection per cost, as measured on texts."""
    rows = []
    for rule in rules:
        spent, hit, n = 0.0, 0, 0
        for a, b, raw, offsets in C.pieces(pa.array(texts, pa.string())):
            s = Stats(raw, offsets)
            began = time.perf_counter()
            hit += int(rule.rejects(s).sum())
            spent += time.perf_counter() - began
            n += b - a
        rows.append((rule, spent / max(n, 1), hit / max(n, 1)))
    return sorted(rows, key=lambda r: -(r[2] + 1e-6) / (r[1] + 1e-9))


def _cut(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offsets)[keep]
    return raw[C.ranges(offsets[:-1][keep], size)], np.concatenate(([0], np.cumsum(size)))


def cascade(raw: np.ndarray, offsets: np.ndarray, rules: Sequence[Rule]) -> np.ndarray:
    """The index of the rule that rejects each text, -1 if none does."""
    verdict = np.full(len(offsets) - 1, -1)
    left = np.arange(len(verdict))
    s = Stats(raw, offsets)
    for i, rule in enumerate(rules):
        if not len(left):
            break
        bad = rule.rejects(s)
        verdict[left[bad]] = i
        if bad.any():
            left = left[~bad]
            s = Stats(*_cut(s.raw, s.offsets, ~bad))
    return verdict


def _judge(rules: Sequence[Rule], counts: bool):
    names = pa.array([r.name for r in rules])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in C.pieces(batch.column(1)):
                by = cascade(raw, offsets, rules)
                out = {"doc_id": batch.column(0).slice(a, b - a)}
                if counts:
                    s = Stats(raw, offsets)
                    repeat = s.repeat_words()
                    out |= {"n_words": s.n_words, "word_chars": s.word_chars(), "n_symbols": s.n_symbols(), "n_dup_lines": s.lines()[1], "n_repeat_words": repeat, "base_failed": (s.n_words < 20) | (100 * repeat > 30 * s.n_words)}
                    out = {k: v if isinstance(v, pa.Array) else pa.array(v, None if v.dtype == bool else pa.int64()) for k, v in out.items()}
                out |= {"kept": pa.array(by < 0), "rejected_by": names.take(pa.array(by, pa.int64(), mask=by < 0))}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    sample = docs.select("text").sample(0.05, seed=7).limit(SAMPLE_ROWS).collect()
    return [r for r, _, _ in order_rules([r.text for r in sample], rules)]


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, base counts, base_failed, kept and rejected_by (the first rule of the cascade to reject it), a row for each row of docs.

    docs: doc_id, text (other columns are ignored). Words are runs without ASCII white space; a null or empty text has none and
    fails. Counts cover whole texts. The sample (SAMPLE_ROWS rows) only orders the rules. A null doc_id stays; an empty table gives an empty result.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(C.lean(_judge(ordered(docs, rules), True)), schema)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs, unchanged and in one pass, that no rule rejects."""
    chosen, at = ordered(docs, rules), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in C.pieces(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(cascade(raw, offsets, chosen) < 0))

    return docs.mapInArrow(C.lean(run), docs.schema)
