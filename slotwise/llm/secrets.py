"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary has long tokens for what people write often, so words take many characters a
token and random strings few. Runs of letters, digits and base64 characters, stretches between the words
of a run, and windows of a stretch are reported where they stay under a ratio of characters to tokens, once
known digests, identifiers and numbers are set aside.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import Taken, extended, without

# The base patterns, whose matches are reported whatever the token test says.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_VALUE = 6
# A maximal run of hex digits is one match whatever its length, so that only long ones need be looked for.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# Of several AKIA in a run only the first can be long enough alone.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
KINDS = ("assign", "access", "hex", "random")

#: Least characters of a run, of a stretch of one and of a window.
LEAST = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Characters a token below which a string counts as random; words of living languages take 3 and more.
MAX_RATIO = 2.0
# Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points; leftmost, non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


WORDLIKE = re.compile(r"[A-Za-z]?[a-z]*[0-9]{0,4}|[A-Z]+[0-9]{0,4}")
#: Parts of up to this many characters can't be told from words.
SHORT = 4


def is_digest(candidate: str) -> bool:
    return len(candidate) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate) is not None


def is_word(part: str, ratio, max_ratio: float = MAX_RATIO) -> bool:
    """A number, or what has the form of a word and not the ratio of a random string, nor a window of such where it is long."""
    if not part or part.isdigit():
        return True
    if WORDLIKE.fullmatch(part) is None:
        return False
    return len(part) <= SHORT or ratio(part) >= max_ratio and (len(part) < 2 * LEAST or not random_windows(part, ratio, max_ratio))


def is_known(candidate: str, ratio, max_ratio: float = MAX_RATIO) -> bool:
    """Digests and identifiers, which look random and aren't secret: hex digests, UUIDs, and names whose parts are all words or all numbers."""
    if is_digest(candidate) or UUID.fullmatch(candidate):
        return True
    return all(is_word(part, ratio, max_ratio) for part in re.split(r"[-_/=+]+", candidate))


class TokenRatio:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ratio", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = {rank: len(token) for token, rank in ranks.items()}

    def lengths(self, candidate: str) -> list[int]:
        """Characters of each token of an ASCII string."""
        return [self.sizes[i] for i in self.encoding.encode_ordinary(candidate)]

    def __call__(self, candidate: str) -> float:
        return len(candidate) / len(self.encoding.encode_ordinary(candidate))


_KEPT: dict[tuple[str, str], TokenRatio] = {}


def stretches(run: str, ratio, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    """(start, end) of what lies between the words, numbers, digests and UUIDs of a run; short parts stay inside a stretch, as base64 may hold them."""
    found, start, end = [], None, 0
    known = {m.start(): m.end() for m in UUID.finditer(run)}
    at = 0
    for m in re.finditer(r"[^-_/=+]+", run):
        if m.start() < at:  # inside a UUID
            continue
        if m.start() in known or is_digest(m.group()) or (m.end() - m.start() > SHORT and is_word(m.group(), ratio, max_ratio)):
            at = known.get(m.start(), m.end())
            if start is not None:
                found.append((start, end))
            start = None
        elif not is_word(m.group(), ratio, max_ratio):
            start, end = m.start() if start is None else start, m.end()
    return found if start is None else [*found, (start, end)]


def random_windows(part: str, ratio, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    """(start, end) of the unions of shortest stretches of tokens with LEAST characters and a ratio under max_ratio."""
    ends = [0]
    for n in ratio.lengths(part):
        ends.append(ends[-1] + n)
    found, j = [], 0
    for i, start in enumerate(ends):
        while j < len(ends) and ends[j] - start < LEAST:
            j += 1
        if j == len(ends):
            break
        if ends[j] - start < max_ratio * (j - i):
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], ends[j])
            else:
                found.append((start, ends[j]))
    return found


def random_spans(text: str, ratio, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """A run that is random as a whole; else its stretches that are; else their windows."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if is_known(run, ratio, max_ratio):
            continue
        if ratio(run) < max_ratio:
            found.append((m.start(), m.end(), "random"))
            continue
        for a, b in stretches(run, ratio, max_ratio):
            if b - a >= LEAST:
                inner = [(0, b - a)] if ratio(run[a:b]) < max_ratio else random_windows(run[a:b], ratio, max_ratio)
                found += [(m.start() + a + c, m.start() + a + d, "random") for c, d in inner]
    return found


def scan_text(text: str | None, ratio, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """Base spans, and random strings that no base span touches; by start, then kind as in KINDS."""
    if not text:
        return []
    base = base_spans(text)
    taken = Taken(base)
    extra = [s for s in random_spans(text, ratio, max_ratio) if not taken.touches(s[0], s[1])]
    return sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str, max_ratio: float = MAX_RATIO, text_col: str = "text") -> DataFrame:
    """docs with secret_spans: array of (start, end, kind), in code points, end exclusive.

    A null or empty text has none; repeated rows are scanned each; a column of docs named
    secret_spans is replaced. Narrow: no shuffle, one text at a time in memory.
    """
    kept = without(docs, ["secret_spans"])
    schema = extended(kept.schema, "secret_spans array<struct<start:long,end:long,kind:string>>")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    at = kept.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = _KEPT.get((ranks_path, pattern)) or _KEPT.setdefault((ranks_path, pattern), TokenRatio(ranks_path, pattern))
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in scan_text(t, ratio, max_ratio)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, spans_type)], names=[*batch.schema.names, "secret_spans"])

    return kept.mapInArrow(scan, schema)


def spans_text(spans):
    """kind:start:end, comma-joined, of an array column of spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
