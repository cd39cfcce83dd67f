"""Secret scans: fixed patterns plus a token-efficiency test.

A random string needs more tokens of a byte-pair vocabulary than text of the
same length. Candidates are runs of key-like characters and their parts between
``/`` and ``=``; those whose characters per token are few are spans of kind
``random``. No candidates are known digests (hexadecimal runs of the usual digest
lengths), UUIDs, dates and numbers, e-mail addresses, host names, and the path of
a link if it is but one short part in one letter case (a page's identifier). All
else in links and dotted names is tested part by part: user names and passwords
before a host, parts of paths, the three parts of a web token. Spans of the fixed
patterns stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, parts, release

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: An assign match ends in one of these words before its sign; texts without them need no search.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
#: A long hexadecimal run holds a digit or is letters only; both start here.
HEX_RUN = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters of a candidate that are given to the tokenizer at a time.
WINDOW = 512
#: Fewer characters per token mark a random string.
MAX_RATIO = 2.0
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMBERS = re.compile(r"[0-9/_=+-]+")

#: Candidates with the signs that join parts of addresses and links.
_WORD = re.compile(r"[A-Za-z0-9+/_=.@:%?&#~!-]{16,}")
_PART = re.compile(r"[^/=]{16,}")
#: A link from the end of its scheme: user names and passwords, host, path.
_LINK = re.compile(r"://(?:[^/?#@]*@)*([^/?#@&]*)(/[^?#]*)?")
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,}")
_DOTTED, _HOST = re.compile(r"[A-Za-z0-9.-]+"), re.compile(r"(?:[a-z0-9-]{1,63}\.)+[a-z]{2,15}|(?:[A-Z0-9-]{1,63}\.)+[A-Z]{2,15}")
_PATH = re.compile(r"(?::[0-9]+)?(/[^?#]*)")
_PAGE = re.compile(r"/(?:[a-z0-9_-]{1,24}|[A-Z0-9_-]{1,24})[/.:!]*")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

_encodings: dict = kept()


def encoding(vocabulary: str, path: str | None = None):
    """The worker's tiktoken encoding of a ranks file, kept between tasks; what other stages kept goes."""
    import public_tokenizers
    import tiktoken

    release(_encodings)
    path = path or public_tokenizers.path(vocabulary)
    if path not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # Runs of {24,} are the runs of + that are long enough: both are maximal.
    found += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    return sorted(found)


def _identifier(run: str) -> bool:
    return bool(_HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run) or _NUMBERS.fullmatch(run))


def _addresses(word: str) -> tuple[str, bytearray]:
    """The word with blanks for schemes, e-mail addresses, host names and page identifiers; where links are (1 up to the host, 2 path)."""
    left, marks = list(word), bytearray(len(word))

    def blank(a: int, b: int) -> None:
        left[a:b] = " " * (b - a)

    def path(m: re.Match, group: int) -> None:
        if m[group]:
            a, b = m.span(group)
            marks[a:b] = b"\x02" * (b - a)
            if _PAGE.fullmatch(m[group]):
                blank(a, b)

    for m in _LINK.finditer(word):
        marks[m.start() : m.end(1)] = b"\x01" * (m.end(1) - m.start())
        blank(m.start(), m.start() + 3)
        blank(*m.span(1))
        path(m, 2)
    if "@" in word:
        found = list(_LOCAL.finditer(word))
        for m, n in zip(found, found[1:]):
            if word[m.end() : n.start()] == "@" and marks[m.start()] != 1 and (d := _DOMAIN.match(n[0])):
                blank(m.start(), n.start() + d.end())
    if "." in word:
        for m in _DOTTED.finditer(word):
            host = m[0].rstrip(".-")
            if (m.start() == 0 or word[m.start() - 1] in "@:=&?") and not marks[m.start()] and _HOST.fullmatch(host):
                blank(m.start(), m.start() + len(host))
                if after := _PATH.match(word, m.end()):
                    path(after, 1)
    return "".join(left), marks


def random_spans(text: str, encoder, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of strings that the vocabulary encodes badly."""
    found = []

    def test(a: int, b: int) -> bool:
        run = text[a:b]
        if _identifier(run):
            return False
        tokens = sum(len(encoder.encode_ordinary(run[i : i + WINDOW])) for i in range(0, len(run), WINDOW))
        if len(run) < max_ratio * tokens:
            found.append((a, 3, b))
        return len(run) < max_ratio * tokens

    for w in _WORD.finditer(text):
        word, at, marks = w[0], w.start(), None
        if not CANDIDATE.search(word):
            continue
        if "." in word or "@" in word or "://" in word:
            word, marks = _addresses(word)
        for m in CANDIDATE.finditer(word):
            in_path = marks is not None and marks[m.start()] == 2
            if in_path or not _identifier(m[0]) and not test(at + m.start(), at + m.end()):
                for part in _PART.finditer(word, *m.span()):
                    if in_path or part.span() != m.span():
                        test(at + part.start(), at + part.end())
    return found


def find_spans(text: str, encoder, max_ratio: float = MAX_RATIO) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; a random span inside a base span adds nothing."""
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], [*accumulate((b for _, _, b in base), max)]
    # The base spans that start no later than a span reach as far as the last entry before its place.
    extra = [x for x in random_spans(text, encoder, max_ratio) if not (i := bisect_right(starts, x[0])) or reach[i - 1] < x[2]]
    return base, sorted(base + extra)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", path: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Secrets of every whole text: counts by kind and spans in code points.

    A null text is empty and has no spans (``base_sha256`` is that of the empty
    string). Null ids and repeated rows are kept; other columns are ignored.
    """

    def run(batches):
        enc = encoding(vocabulary, path)
        for batch in parts(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = find_spans(text or "", enc, max_ratio)
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*counts[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), counts[3]))
            types = (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str = "byte_bpe_50k.tiktoken", path: str | None = None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns, with every span replaced by ``mark``.

    Overlapping spans are replaced together. ``length`` is set to the new number
    of characters where a text changed; other texts, nulls included, stay.
    """
    names = docs.columns
    has_length = length in names

    def run(batches):
        enc = encoding(vocabulary, path)
        for batch in parts(batches):
            texts = batch.column(text).to_pylist()
            lengths = batch.column(length).to_pylist() if has_length else None
            for i, t in enumerate(texts):
                spans = find_spans(t, enc)[1] if t else []
                if not spans:
                    continue
                out, at = [], 0
                for a, _, b in spans:
                    if b <= at:
                        continue
                    if a >= at:
                        out += [t[at:a], mark]
                    at = b
                texts[i] = "".join(out) + t[at:]
                if has_length:
                    lengths[i] = len(texts[i])
            new = {text: pa.array(texts, pa.string())} | ({length: pa.array(lengths, batch.column(length).type)} if has_length else {})
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
