"""Secret scans: three fixed patterns, and dictionary-primed zstandard novelty for what they don't know.

A candidate is a long token near a sensitive word. Its novelty is its marginal compressed size: the bytes that it adds to its
surroundings under a compressor primed with a dictionary of code words and identifiers. A token that compresses hardly at all
is random, and is reported; words, paths and repeated identifiers are not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(r"(?i:bearer|authorization|credential|private|signature|client_id|session|cookie|\bkey|\bauth|\bpwd|\bpass\b|secret|token|passw)")
NEAR = 40  # characters on either side of a candidate in which a sensitive word is looked for
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "novel")
WORDS = (
    "function return class def import from const let var public private static void string number int bool true false null none self this "
    "if else elif for while try except catch finally throw new delete export default async await yield lambda print console log "
    "index value name type data list array object map key token secret password passwd api_key apikey credential bearer authorization "
    "session cookie signature client_id client_secret access_key private_key public_key username user email config settings environment "
    "http https www com org net localhost host port path file url uri request response header content length encoding utf-8 base64 json xml "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 example sample test placeholder changeme your_key_here xxxxxxxxxxxxxxxx 0000000000000000"
)
#: Parts of long words, so that these are no news to the compressor.
PARTS = (
    "ation ition ution tional ment ments ness able ible ibly inter intra trans super under over counter multi semi anti auto micro macro tele photo graph graphy logical ology istic "
    "ically ative itive ance ence ancy ency ious eous uous ular ulate ified ifying ization isation izing ising ship hood ward wise less fully ingly ated ating ators ories aries isms ively "
    "ities ought tion sion cture tures there with from this have been were what when where which while would could should about after again against before between during through without "
    "server client service provider handler manager controller factory builder adapter wrapper context message response status error result option setting parameter argument variable method "
    "module package library system process thread memory storage database record field column table query update insert select create remove account profile payment gateway customer order "
    "product address country number identifier internal external national administration communication representation responsibility character"
)
MIN_NOVELTY = 0.92  # marginal bytes for each character: a random token finds no match, words and identifiers do


PLAIN_NOVELTY, PLAIN_MATCHES = 0.72, 0.98  # asked of a token that hardly changes between kinds of characters: both, the first with entropy coding

#: Letter runs of words are long and few; random tokens change between digits, capitals and small letters all the time.
_TURN = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])")


class Novelty:
    """Marginal compressed bytes under a dictionary of identifiers."""

    def __init__(self, words: str = f"{PARTS} {WORDS}"):
        self.matches = Matches(words)
        self.of = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def __call__(self, before: str, token: str, after: str) -> float:
        around = f"{before}\n{after}\n".encode()
        extra = len(self.of.compress(around + token.encode() + b"\n")) - len(self.of.compress(around))
        return extra / max(1, len(token.encode()))


#: Follows the token or stands in its place, so that matches before it are found in both cases: the compressor looks for none in its last bytes.
_TAIL = bytes(range(128, 160))


class Matches:
    """Marginal compressed bytes without entropy coding: what of a token is no match, whatever its alphabet and length.

    The context begins with some of the dictionary, so that it is never stored raw.
    """

    def __init__(self, words: str = f"{PARTS} {WORDS}"):
        parameters = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, write_content_size=False)
        self.of = zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.start = words[:400]

    def __call__(self, before: str, token: str, after: str) -> float:
        around = f"{self.start}\n{before}\n{after}\n".encode()
        extra = len(self.of.compress(around + token.encode() + b"\n" + _TAIL)) - len(self.of.compress(around + _TAIL))
        return extra / max(1, len(token.encode()))


def _hex_runs(raw: np.ndarray) -> np.ndarray:
    """Whether each byte ends sixteen bytes of lower-case hexadecimal."""
    ok = np.zeros(256, bool)
    ok[list(b"0123456789abcdef")] = True
    s = np.concatenate(([0], np.cumsum(ok[raw])))
    out = np.zeros(len(raw), bool)
    out[15:] = s[16:] - s[:-16] == 16
    return out


def scan_text(text: str, novelty: Novelty, has_hex: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, in code points, by start and then kind."""
    low = text.lower()
    out: list[tuple[int, int, str]] = []
    if any(h in low for h in HINTS) or not text.isascii():
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if has_hex:
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    taken, k, reach = sorted((a, b) for a, b, _ in out), 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach > a or not (SENSITIVE.search(text, max(0, a - NEAR), a) or SENSITIVE.search(text, b, b + NEAR)):
            continue
        token = m[0]
        turns = len(_TURN.findall(token))
        around = text[max(0, a - 200) : a], token, text[b : b + 200]
        if 8 * turns < len(token):
            if novelty(*around) >= PLAIN_NOVELTY and novelty.matches(*around) >= PLAIN_MATCHES:
                out.append((a, b, "novel"))
            continue
        # entropy coding shortens long tokens of few symbols; without it unknown words look new too, so more turns are asked
        if novelty(*around) >= MIN_NOVELTY or (5 * turns >= len(token) and novelty.matches(*around) >= MIN_NOVELTY):
            out.append((a, b, "novel"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _maybe(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a text can hold any span, and any hexadecimal run: all spans have an assignment's word, AKIA or a long token."""
    s = np.concatenate(([0], np.cumsum(_hex_runs(raw))))
    ends = np.minimum(offsets[:-1] + 15, offsets[1:])
    return s[offsets[1:]] - s[ends] > 0


def _spans(batch: pa.RecordBatch, at: int, novelty: Novelty):
    """(row, text, spans) of the whole batch."""
    for a, b, raw, offsets in C.pieces(batch.column(at)):
        hexes = _maybe(raw, offsets)
        for i, text in enumerate(batch.column(at).slice(a, b - a).to_pylist()):
            yield a + i, text, scan_text(text, novelty, bool(hexes[i])) if text else []


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for batch in batches:
        found = [s for _, _, s in _spans(batch, 1, novelty)]
        count = [pa.array([sum(k == kind for _, _, k in s) for s in found], pa.int64()) for kind in KINDS]
        digest = [hashlib.sha256(joined([x for x in s if x[2] != "novel"]).encode()).hexdigest() for s in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), *count[:3], pa.array(digest, pa.string()), pa.array([joined(s) for s in found], pa.string()), count[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points), n_novel for each row of docs.

    docs: doc_id, text (other columns are ignored). A null or empty text has no span. An assignment's span is the whole match.
    Spans of base patterns may overlap each other; a novel span overlaps none of them. A null doc_id stays, repeated rows too; an empty table gives an
    empty result. A very long text is scanned whole, in time that grows with its length.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(C.lean(_scan), schema)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mask (overlapping spans by one); n_chars, if there, follows the text. Null texts stay."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            texts, counts = batch.column(at).to_pylist(), batch.column(chars).to_pylist() if chars is not None else None
            for i, text, spans in _spans(batch, at, novelty):
                if not spans:
                    continue
                out, last = [], 0
                for a, b, _ in spans:
                    if a >= last:
                        out += [text[last:a], mask]
                    last = max(last, b)
                texts[i] = "".join([*out, text[last:]])
                if counts:
                    counts[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counts:
                columns[chars] = pa.array(counts, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(C.lean(run), docs.schema)
