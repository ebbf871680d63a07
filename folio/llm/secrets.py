"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A run of at least ``MIN_RUN`` base64-like characters, letters among them, is random where a
byte-level BPE vocabulary, read by tiktoken, needs a token for fewer than ``RATIO`` characters: words and
identifiers take far more characters a token. Known digests (bare hex of the usual lengths), UUIDs,
hexadecimal numbers, ISO times and dotted versions are left out first, and identifiers where the vocabulary knows their parts as words.

Every whole text is read; a null text is empty. Positions are code points, ends exclusive. Base spans
stay as they are; a random span is added only where no base span overlaps it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import record, slices

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 16
RATIO = 2.4
#: For runs of letters alone: long words of other languages take about 2.4 characters a token, random letters 1.7.
LETTERS = 2.2
MASK = "[secret]"
RANKS = "byte_bpe_50k.tiktoken"
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
_KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|\d[\d/_+-]*|0[xX][0-9a-fA-F]+|\d{4}-\d\d-\d\d[T_]?\d{0,6}Z?)=*"
)
_WORDY = re.compile(r"(?:[A-Z]{2,}|[A-Z]?[a-z]{2,})(?:\d{0,4}[/_+-]*(?:[A-Z]{2,}|[A-Z]?[a-z]{2,}))*\d{0,4}")
_PART = re.compile(r"[A-Z]{2,}(?![a-z])|[A-Z]?[a-z]+|[A-Z]+")
#: Characters a token that make a part of three letters or more a word.
WORD_RATIO = 3.0
_encodings: dict = {}


def vocabulary_path(name: str = RANKS) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's number, end, kind) would sort alike: by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX_RUN.finditer(text)]  # runs are maximal, so the bound can be in the pattern
    return found


def _tokens(text: str, path: str) -> int:
    return len(_encoding(path).encode_ordinary(text))


def identifier(core: str, path: str) -> bool:
    """Whether a run is shaped like an identifier and its parts are words by the vocabulary, short ones being the lesser part."""
    if not _WORDY.fullmatch(core):
        return False
    parts = _PART.findall(core)
    long = [p.lower() for p in parts if len(p) > 2]
    if 3 * sum(map(len, long)) < 2 * sum(map(len, parts)):
        return False
    return all(len(p) >= WORD_RATIO * min(_tokens(p, path), _tokens(" " + p, path)) for p in long)


def random_spans(text: str, path: str, taken: list[tuple[int, int, int]], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    found = []
    for m in _RUN.finditer(text):
        run = m[0]
        core = run.strip("=-_/+")
        if len(core) < MIN_RUN or not re.search(r"[A-Za-z]", core):
            continue
        if _KNOWN.fullmatch(run) or _KNOWN.fullmatch(core):
            continue
        if any(a < m.end() and m.start() < b for a, _, b in taken):
            continue
        pieces = [core[i : i + 4096] for i in range(0, len(core), 4096)]  # a token never needs more at once
        least = min(ratio, LETTERS) if core.isalpha() else ratio
        if len(core) < least * sum(_tokens(p, path) for p in pieces) and not identifier(core, path):
            found.append((m.start(), 3, m.end()))
    return found


def scan(text: str | None, path: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each (start, kind's number, end) in order."""
    text = text or ""
    base = sorted(base_spans(text)) if text else []
    return base, sorted(base + random_spans(text, path, base)) if text else []


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str, spans: list[tuple[int, int, int]], by: str = MASK) -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_random", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def secret_spans(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans and all spans."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, found = scan(text, path)
                counts = [sum(k == x for _, k, _ in found) for x in range(4)]
                rows.append((doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(found)))
            yield record(_OUT, *zip(*rows))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All documents, with every secret in ``text`` masked and ``n_chars``, where there is one, counted anew where text changed."""
    path = path or vocabulary_path()
    kind = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            out = [t if not (s := scan(t, path)[1]) else mask(t, s) for t in texts]
            columns = dict(zip(b.schema.names, b.columns))
            columns["text"] = pa.array(out, b.schema.field("text").type)
            if "n_chars" in columns:
                counts = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(o) if o != t else c for o, t, c in zip(out, texts, counts)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=b.schema)

    return docs.mapInArrow(run, kind)


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    return secret_spans(table(spark, sf_dir, "documents"))
