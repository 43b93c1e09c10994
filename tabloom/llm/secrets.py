"""Secret scans: named patterns, and sliding-window Shannon entropy over candidate strings with an allow-list.

Candidates are runs of CANDIDATE characters inside words. A window of WINDOW characters slides over each; counts per
character change by one in and one out, so the entropy is updated in constant time. A window is judged by its character
class: hexadecimal, or mixed (at least two of lower case, upper case and digits). Windows over the threshold of their
class merge into spans of kind `entropy`. The allow-list judges every span by itself: it drops one inside the host and path
of a web address or inside a file path, one that identifiers of fixed form, placeholders, alphabet runs and dates cover up
to fewer than LEAST["assign"] characters in a row, and runs of letters and separators alone. User info and query values
of an address are not its path. Spans of the named patterns are never dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabloom.llm.base import map_batches

# fixed values: the named patterns and the least lengths of their matches
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "entropy"]
#: Words that can hold a span of kind access, hex or entropy.
LONG = re.compile(r"\S{16,}")
KEYWORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits per character from which a window is suspicious, by class.
THRESHOLDS = {"hex": 3.2, "mixed": 3.7}
ALLOWED = [
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?i)example|placeholder|changeme|your[_-]?(key|token|secret)|x{6,}|0{8,}|redacted"),
    re.compile(r"(?i)abcdefgh|012345678|123456789|qwertyuiop"),
    re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    re.compile(r"[A-Za-z/_=+-]*"),
]
#: The host and path of an address, which end at a quote, comma, bracket, query or value; user info goes before them.
_ADDRESS = re.compile(
    r"""(?i)(?:(?:https?|ftp|file)://(?:[^\s"'`,;<>()\[\]{}|\\?#/@]*@)?|(?<![a-z0-9])www\.)([^\s"'`,;<>()\[\]{}|\\?#=/@]*(?:/[^\s"'`,;<>()\[\]{}|\\?#=]*)?)"""
)
_PATH = re.compile(r"""(?:\.{0,2}|~)/[^\s"'`,;<>()\[\]{}|\\?#=]*""")
_LEAD = re.compile(r"(?:\.{1,2}|~)?[A-Za-z0-9+/_=-]*")
_BITS = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def entropy_windows(run: str) -> Iterator[tuple[int, int]]:
    """Merged (start, end) of suspicious windows in one candidate string."""
    counts: dict[str, int] = {}
    kinds, other, total = [0, 0, 0, 0], 0, 0.0
    begin = end = -1
    full = math.log2(WINDOW)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _BITS[n + 1] - _BITS[n]
        kinds[_kind(c)] += 1
        other += c not in "0123456789abcdefABCDEF"
        if i >= WINDOW:
            out = run[i - WINDOW]
            n = counts[out]
            counts[out] = n - 1
            total += _BITS[n - 1] - _BITS[n]
            kinds[_kind(out)] -= 1
            other -= out not in "0123456789abcdefABCDEF"
        if i < WINDOW - 1:
            continue
        mixed = (kinds[0] > 0) + (kinds[1] > 0) + (kinds[2] > 0) >= 2
        if other == 0 and kinds[2] and kinds[0] + kinds[1]:
            least = THRESHOLDS["hex"]
        elif mixed:
            least = THRESHOLDS["mixed"]
        else:
            continue
        if full - total / WINDOW + 1e-9 >= least:
            start = i - WINDOW + 1
            if start > end:
                if end >= 0:
                    yield begin, end
                begin = start
            end = i + 1
    if end >= 0:
        yield begin, end


def _allowed(run: str, begin: int, end: int) -> bool:
    """True if fixed forms, placeholders, alphabet runs and dates cover a span of the run but for parts too short for a secret."""
    upto = begin
    for a, b in sorted(m.span() for p in ALLOWED[:4] for m in p.finditer(run) if m.start() < end and m.end() > begin):
        if a - upto >= LEAST["assign"]:
            return False
        upto = max(upto, b)
    return end - upto < LEAST["assign"]


def _paths(word: str) -> list[tuple[int, int]]:
    """Where the addresses of a word have their host and path, and the file path it begins with has what follows its first run."""
    found = [m.span(1) for m in _ADDRESS.finditer(word)]
    if path := _PATH.match(word):
        found.append((_LEAD.match(word).end(), path.end()))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the named patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for word in LONG.finditer(text):
        at, w = word.start(), word[0]
        if "AKIA" in w:
            found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(w) if len(m[0]) >= LEAST["access"]]
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(w) if len(m[0]) >= LEAST["hex"]]
    return sorted(found)


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    for word in LONG.finditer(text):
        w, at, paths = word[0], word.start(), None
        for m in CANDIDATE.finditer(w):
            spans, first = list(entropy_windows(m[0])), m.start()
            if not spans or any(p.fullmatch(m[0]) for p in ALLOWED[4:]):
                continue
            if paths is None:
                paths = _paths(w)
            for a, b in spans:
                if not _allowed(m[0], a, b) and not any(x <= first + a and first + b <= y for x, y in paths):
                    found.append((at + first + a, 3, at + first + b))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans: counts 0, the checksum of nothing and an empty string. Repeated rows are
    reported alike; an empty table gives an empty result.
    """

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in batch["text"]:
            base = base_spans(text) if text else []
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + entropy_spans(text))) if text else "")
        return out | {"doc_id": batch["doc_id"]}

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_batches(docs.select("doc_id", "text"), schema, run)


def redact(text: str | None) -> str | None:
    """Replace every secret by [SECRET]; overlapping spans become one."""
    spans = sorted(base_spans(text) + entropy_spans(text)) if text else []
    if not spans:
        return text
    parts, upto = [], 0
    end = -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                upto = end
            parts += [text[upto:a], "[SECRET]"]
        end = max(end, b)
    return "".join(parts) + text[end:]


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, with secrets in `text` replaced; an integer column `n_chars` follows the text.

    Null and empty texts stay as they are, repeated rows change alike, and an empty table gives an empty result.
    """
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # Arrow functions cannot take every column name
    schema = docs.schema
    counted = any(n == "n_chars" and isinstance(f.dataType, T.IntegralType) for n, f in zip(names, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 128) for whole in batches for k in range(0, whole.num_rows, 128)):
            old = batch.column(names.index("text"))
            text = [redact(t) for t in old.to_pylist()]
            arrays = list(batch.columns)
            arrays[names.index("text")] = pa.array(text, old.type)
            if counted:
                n = batch.column(names.index("n_chars"))
                new = [len(t) if t is not None and t != o else k for t, o, k in zip(text, old.to_pylist(), n.to_pylist())]
                arrays[names.index("n_chars")] = pa.array(new, n.type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, schema).toDF(*names)
