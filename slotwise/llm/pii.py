"""Personal data: fixed patterns, and bootstrapped contextual extraction.

The base spans (addresses, IPs, cards, phones) are the seeds. A mention is a seed, another token or group of numbers with a
digit or an @, or any word after a pattern that could be trusted. Its lexical patterns are the two words before it, and the
words on either side of it. Patterns and instances (the mentions' normalised values) form a graph that Spark scores in
rounds: a pattern's confidence is the mean over its instances, an instance's is that of its best pattern, or, if it is a
plain word, the mean of its patterns', so that a common word after a trusted pattern isn't trusted; only confident
ones count. Confident instances vouch for further patterns, those for further instances.

Plain words are read from the texts anew when there are more hopeful patterns or words, until there are none. What a
scan looks for travels as bitmaps of fixed size; what they let through by mistake goes in a join. Mentions of
confident new instances after confident patterns are reported as kind "context".
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import Taken, delete_table, extended, materialize, without
from slotwise.llm.secrets import sha256_hex

KINDS = ("email", "ip", "card", "phone", "context")
# The base patterns, in forms that need no second try at a start that failed.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\t-\r]+")
#: A name inside a token, without punctuation around it, and the groups of digits that go on with one that has a digit.
_NAME = re.compile(r"(?<![\w@._/#+-])[._/-]*([\w@+#](?:[\w@._/#+-]*\w)?)")
_GROUPS = re.compile(r"(?:\x20[0-9]+(?!\w))+")
_DIGITS = re.compile(r"[0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def email_spans(text: str) -> list[tuple[int, int]]:
    """At each @, the longest run of local characters before it that no earlier match holds, and the domain after it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping for each kind; by kind, then start."""
    found = [(a, b, "email") for a, b in email_spans(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


def _shape(text: str) -> str:
    """Lower case, numbers as 0; of a text the same as of its words (a final sigma is like any other)."""
    return _DIGITS.sub("0", text.lower().replace("ς", "σ"))


def _instance(value: str) -> str:
    return re.sub(r"[\x20().-]", "", value).lower()


def is_plain(value: str) -> bool:
    return not _DIGIT.search(value) and "@" not in value


class Words:
    """A text's tokens, for the patterns of its mentions."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.spans]
        self._at, self._names = -1, []

    def index(self, at: int) -> int:
        """The token that holds the character."""
        return bisect_right(self.starts, at) - 1

    def shape(self, i: int) -> str | None:
        return _shape(self.text[slice(*self.spans[i])]) if 0 <= i < len(self.spans) else None

    def names(self, i: int) -> list[tuple[int, int, str | None, str | None]]:
        """(start, end, word before, word before that) of each name in token i. Inside a token the word before a name is
        the name before and the marks between; the one before that is the token before, if the name is the second."""
        if i == self._at:
            return self._names
        found: list[tuple[int, int, str | None, str | None]] = []
        for m in _NAME.finditer(self.text, *self.spans[i]):
            start, end = m.span(1)
            if not found:
                found.append((start, end, self.shape(i - 1), self.shape(i - 2)))
            else:
                found.append((start, end, _shape(self.text[found[-1][0] : start]), self.shape(i - 1) if len(found) == 1 else None))
        self._at, self._names = i, found
        return found

    def before(self, at: int) -> tuple[str | None, str | None]:
        """The two words before a span that starts at `at`, be that inside a name or not."""
        i = self.index(at)
        names = self.names(i)
        n = bisect_right(names, at, key=lambda x: x[0]) - 1
        return names[n][2:] if n >= 0 and at < names[n][1] else (self.shape(i - 1), self.shape(i - 2))

    def patterns(self, end: int, before: str | None, first: str | None) -> list[str]:
        """Patterns of a mention that ends at `end`: the words before it, and the words on either side, where both are."""
        if before is None:
            return []
        found = [f"{first} {before}" if first is not None else before]
        i = self.index(end - 1)
        after, last = self.shape(i + 1), self.spans[i][1]
        while end < last and not self.text[end].isalnum():
            end += 1
        if after is not None and end == last:
            found.append(f"{before} _ {after}")
        return found


def mentions(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, bool, list[str], str]]:
    """(start, end, seed?, patterns, instance) of base spans and of names with a digit or an @ apart from them; of those with a pattern."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    words, taken, out = Words(text), Taken(base), []
    for a, b, _ in base:
        out.append((a, b, True, words.patterns(b, *words.before(a)), _instance(text[a:b])))
    done = 0
    for i in dict.fromkeys(words.index(m.start()) for m in re.finditer(r"[0-9]+|@", text)):
        for a, b, before, first in words.names(i):
            if a < done or is_plain(text[a:b]):
                continue
            if m := _GROUPS.match(text, b):
                b = m.end()
            done = b
            if not taken.touches(a, b):
                out.append((a, b, False, words.patterns(b, before, first), _instance(text[a:b])))
    return [m for m in out if m[3]]


#: Bits of a bitmap, so 0.5 MB each, whatever it holds.
BITS = 22
#: Distinct plain words after a pattern at which a scan lets it go, by class; a pattern is in the first class that it may not exceed.
BOUNDS = (4, 16, 64, 256, 1024, 4096, 16384, None)


def _places(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(key, 42)
    return h & ((1 << BITS) - 1), h >> BITS & ((1 << BITS) - 1)


def bitmaps(keys: DataFrame, kinds: int) -> list[bytes]:
    """Bits of the strings of each kind. keys: kind (int), key. At most kinds * 2^BITS / 64 rows of 20 bytes reach the driver."""
    h, low = F.xxhash64("key"), (1 << BITS) - 1
    places = keys.select("kind", F.explode(F.array(h.bitwiseAND(F.lit(low)), F.shiftrightunsigned(h, BITS).bitwiseAND(F.lit(low)))).alias("at"))
    words = places.groupBy("kind", F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros((kinds, 1 << (BITS - 6)), dtype="<i8")
    out[words.column("kind").to_numpy(), words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return [row.tobytes() for row in out]


def holds(bits: bytes, key: str) -> bool:
    """False only for what the bitmap wasn't made of."""
    a, b = _places(key.encode())
    return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)


class Memo(dict):
    """What `find` gives, kept for the first `most` keys."""

    def __init__(self, find: Callable, most: int = 200_000):
        self.find, self.most = find, most

    def __missing__(self, key):
        found = self.find(key)
        if len(self) < self.most:
            self[key] = found
        return found


#: Marks between two names of a token.
_INNER = re.compile(r"[\w@+#][^\w@._/#+-]+[._/-]*[\w@+#]")


class PlainWords:
    """Finds the names without digit and @ in a task's texts that follow a wanted pattern or are a wanted word.

    A token is first looked up: may a wanted pattern end with it (1), or inside it, or does it hold a wanted word (2)? Then its
    neighbours tell whether the whole pattern is wanted. A text's words are only cut up where something is.
    """

    def __init__(self, every: bytes, ends: bytes, words: bytes, classes: list[bytes]):
        self.every, self.ends, self.words, self.classes, self.any_words = every, ends, words, classes, any(words)
        self.tokens, self.pairs, self.levels = Memo(self._flags), Memo(self._pair), Memo(self._level)
        self.dead: set[str] = set()
        self.seen: dict[str, set[str]] = {}

    def _flags(self, token: bytes) -> int:
        """token: of a text in its shape."""
        text = token.decode()
        found = int(holds(self.ends, text))
        if self.any_words or _INNER.search(text):
            for n, (a, b, before, _) in enumerate(Words(text).names(0)):
                if n and holds(self.ends, before) or self.any_words and is_plain(text[a:b]) and holds(self.words, _instance(text[a:b])):
                    return found + 2
        return found

    def _pair(self, key: tuple[bytes | None, bytes, bytes]) -> str | None:
        pattern = b"".join(key[0] is None and key[2:] or key).decode()
        return pattern if holds(self.every, pattern) else None

    def _level(self, pattern: str) -> int:
        return max((i for i, bits in enumerate(self.classes) if holds(bits, pattern)), default=-1)

    def wanted(self, pattern: str | None) -> bool:
        return pattern is not None and pattern not in self.dead and self.levels[pattern] >= 0

    def mentions(self, text: str, base: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[str], str]]:
        """(start, end, patterns, instance)."""
        tokens = _shape(text).encode().split()  # of bytes: at ASCII white space alone
        flags = list(map(self.tokens.__getitem__, tokens))
        at, pairs = set(), self.pairs
        for i in compress(count(), flags):
            if flags[i] & 2:
                at.add(i)
            if flags[i] & 1 and i + 1 < len(tokens):
                left = pairs[tokens[i - 1] if i else None, b" ", tokens[i]]
                around = pairs[tokens[i], b" _ ", tokens[i + 2]] if i + 2 < len(tokens) else None
                if left is not None and self.wanted(left) or around is not None and self.wanted(around):
                    at.add(i + 1)
        if not at:
            return
        words, taken = Words(text), Taken(base)
        for i in sorted(at):
            for a, b, before, first in words.names(i):
                if is_plain(text[a:b]) and not taken.touches(a, b):
                    patterns, instance = words.patterns(b, before, first), _instance(text[a:b])
                    if any(map(self.wanted, patterns)) or patterns and holds(self.words, instance):
                        yield a, b, patterns, instance

    def new_pairs(self, patterns: list[str], instance: str) -> Iterator[tuple[str, str]]:
        """(pattern, instance) not yet given: any of a wanted word, else of wanted patterns, each until it has more distinct words than its bound."""
        known = holds(self.words, instance)
        for p in patterns:
            if not known and not self.wanted(p):
                continue
            seen = self.seen.setdefault(p, set())
            if instance not in seen:
                seen.add(instance)
                yield p, instance
                bound = BOUNDS[self.levels[p]]
                if not known and bound is not None and len(seen) > bound:
                    self.dead.add(p)
                    self.seen[p] = {x for x in seen if holds(self.words, x)}


def _last_word(pattern):
    """The word right before the mentions of a pattern."""
    return F.regexp_extract(pattern, r"([^\x20]+)(?: _ [^\x20]+)?$", 1)


def _scan(scanned: DataFrame, text_col: str, patterns: DataFrame, words: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """What rows(finder, _row, start, end, patterns, instance) gives for all texts. patterns: pattern, class; words: instance."""
    kinds = len(BOUNDS)
    keys = patterns.select(F.col("class").alias("kind"), F.col("pattern").alias("key"))
    for more in (patterns.select("pattern"), patterns.select(_last_word("pattern")), words.select("instance")):
        keys, kinds = keys.union(more.select(F.lit(kinds), F.col(more.columns[0]))), kinds + 1
    held = scanned.sparkSession.sparkContext.broadcast(bitmaps(keys, kinds))
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *classes, whole, ends, known = held.value
        finder = PlainWords(whole, ends, known, classes)
        for batch in batches:
            out = []
            for row, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for m in finder.mentions(text or "", [(s["start"], s["end"]) for s in spans]):
                    out += rows(finder, row, *m)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return materialize(scanned.select("_row", text_col, "pii_spans").mapInArrow(scan, schema), "pii-plain")


def _plain_pairs(scanned: DataFrame, text_col: str, patterns: DataFrame, words: DataFrame) -> DataFrame:
    """pattern, instance of plain words: all of `words`, and of each of patterns (pattern, class) all, or more than its class allows."""
    rows = _scan(scanned, text_col, patterns, words, lambda finder, row, a, b, found, instance: finder.new_pairs(found, instance), "pattern string, instance string")
    called = rows.distinct().join(patterns.select("pattern", F.lit(True).alias("_p")), "pattern", "left").join(words.select("instance", F.lit(True).alias("_i")), "instance", "left")
    return materialize(called.where("_p or _i").select("pattern", "instance"), "pii-called")


def _plain_spans(scanned: DataFrame, text_col: str, patterns: DataFrame, words: DataFrame) -> DataFrame:
    """_row, start, end of those of words that follow one of patterns (pattern)."""
    rows = _scan(scanned, text_col, patterns.withColumn("class", F.lit(len(BOUNDS) - 1)), words, lambda finder, row, a, b, found, instance: [(row, a, b, p, instance) for p in found], "_row long, start long, end long, pattern string, instance string")
    return rows.join(patterns, "pattern", "left_semi").join(words, "instance", "left_semi").select("_row", "start", "end")


def score_graph(edges: DataFrame, least_seeds: int, least_score: float, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence, total) and (instance, plain, seed, confidence) at the fixed point; of patterns those of least_score.

    edges: pattern, instance, seed, plain; one row each. Confidences start at 1 for seeds, else 0, and never fall, since
    means and maxima of greater values are greater; so the rounds end. On either side what is below least_score counts
    as 0, so that nothing lifts itself. A pattern needs least_seeds confident instances. total: the sum of their confidences.
    """
    now = materialize(edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.max("plain").alias("plain")).withColumn("confidence", F.col("seed").cast("double")), "pii-instances")
    while True:
        sure = F.when(F.col("confidence") >= least_score, F.col("confidence")).otherwise(0.0)
        means = edges.select("pattern", "instance").join(now.select("instance", "confidence"), "instance").groupBy("pattern").agg(F.avg(sure).alias("confidence"), F.sum(sure).alias("total"), F.sum((sure > 0).cast("long")).alias("support"))
        patterns = materialize(means.where(f"support >= {least_seeds} and confidence >= {least_score}").drop("support"), "pii-patterns")
        scored = F.coalesce("confidence", F.lit(0.0))
        by_instance = edges.join(patterns, "pattern", "left").groupBy("instance").agg(F.avg(scored).alias("mean"), F.max(scored).alias("best"))
        moved = by_instance.join(now.withColumnRenamed("confidence", "was"), "instance").withColumn("confidence", F.when(F.col("seed"), 1.0).when(F.col("plain"), F.col("mean")).otherwise(F.col("best")))
        after = materialize(moved.select("instance", "seed", "plain", "confidence", (F.col("confidence") > F.col("was") + tolerance).alias("rose")), "pii-instances")
        settled = after.where("rose").isEmpty()
        delete_table(now)
        now = after.drop("rose")
        if settled:
            return patterns, now
        delete_table(patterns)


def _confident_mentions(scanned: DataFrame, text_col: str, single: DataFrame, least_seeds: int, least_score: float) -> DataFrame:
    """_row, start, end of the mentions that are no seeds and whose pattern and instance are confident.

    single: _row, start, end, seed, pattern, instance of all mentions but plain words. While a pattern is not read, plain words
    after it are not in the graph, so its confidence is too high: hopeful patterns, and words that are hopeful by the
    patterns known, are read from all texts, and the graph is scored again, until all that are confident have been
    read. Of a pattern that more words follow than its confident instances can make up for, only so many words are
    read as to show it; no bound decides otherwise than all of its words would.
    """
    pairs = materialize(single.groupBy("pattern", "instance").agg(F.max("seed").alias("seed_here")), "pii-pairs")
    seeds = pairs.groupBy("instance").agg(F.max("seed_here").alias("seed")).where("seed")
    edges = materialize(pairs.join(seeds, "instance", "left").select("pattern", "instance", F.coalesce("seed", F.lit(False)).alias("seed"), F.lit(False).alias("plain")), "pii-edges")
    delete_table(pairs)
    of_bound = F.lit(len(BOUNDS) - 1)
    for i, bound in reversed(list(enumerate(BOUNDS[:-1]))):
        of_bound = F.when(F.col("total") / least_score <= bound, F.lit(i)).otherwise(of_bound)
    read_patterns, read_words = edges.select("pattern", F.lit(0).alias("class")).where("false"), edges.select("instance").where("false")
    plain = edges.select("pattern", "instance").where("false")
    while True:
        graph = materialize(edges.unionByName(plain.select("pattern", "instance", F.lit(False).alias("seed"), F.lit(True).alias("plain"))), "pii-graph")
        patterns, instances = score_graph(graph, least_seeds, least_score)
        good_words = instances.where(f"confidence >= {least_score} and plain").select("instance")
        classed = patterns.select("pattern", of_bound.cast("int").alias("class"))
        more_patterns = classed.join(read_patterns.withColumnRenamed("class", "was"), "pattern", "left").where("was is null or class > was").select("pattern", "class")
        more_words = good_words.join(read_words, "instance", "left_anti")
        delete_table(graph)
        if more_patterns.isEmpty() and more_words.isEmpty():
            break
        every = read_patterns.unionByName(more_patterns).groupBy("pattern").agg(F.max("class").alias("class"))
        read_patterns, read_words = materialize(every, "pii-read"), materialize(read_words.unionByName(more_words), "pii-read")
        plain = _plain_pairs(scanned, text_col, read_patterns, read_words)
    known = single.where("not seed").join(patterns, "pattern", "left_semi").join(instances.where(f"confidence >= {least_score} and not plain"), "instance", "left_semi").select("_row", "start", "end")
    if good_words.isEmpty():
        return known.distinct()
    return known.unionByName(_plain_spans(scanned, text_col, patterns.select("pattern"), good_words)).distinct()


def find_pii(docs: DataFrame, least_seeds: int = 3, least_score: float = 0.8, text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256 and pii_spans: array of (start, end, kind), in code points.

    Spans are by kind as in KINDS, then start; base spans always stay. Seeds, patterns and scores
    come from all texts. A null or empty text has no spans; repeated rows get each their own; an empty table stays
    empty; columns of docs named like a result are replaced. Mentions, the rows of the graph, carry no text; the table
    that is read once and written holds a text once. least_seeds, least_score: see score_graph.
    """
    results = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "pii_spans")
    kept = without(docs, [*results, "_row", "_mentions"])
    at = kept.columns.index(text_col)
    span = "struct<start:long,end:long,kind:string>"
    mention = "struct<start:long,end:long,seed:boolean,patterns:array<string>,instance:string>"
    schema = extended(kept.schema, f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, pii_spans array<{span}>, _mentions array<{mention}>, _row long")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    mention_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string())), ("instance", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            base, held = [], []
            for text in batch.column(at).to_pylist():
                base.append(base_spans(text or ""))
                held.append([dict(zip(("start", "end", "seed", "patterns", "instance"), m, strict=True)) for m in mentions(text or "", base[-1])])
            counts = [pa.array([sum(k == kind for _, _, k in spans) for spans in base], pa.int64()) for kind in KINDS[:4]]
            digests = [sha256_hex(",".join(f"{k}:{a}:{b}" for a, b, k in spans)) for spans in base]
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in base]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(digests, pa.string()), pa.array(spans, span_type), pa.array(held, mention_type), pa.array(range(row, row + len(base)), pa.int64())], names=[*batch.schema.names, *results, "_mentions", "_row"])
            row += len(base)

    scanned = materialize(kept.mapInArrow(scan, schema), "pii")
    exploded = scanned.select("_row", F.explode("_mentions").alias("m")).select("_row", "m.start", "m.end", "m.seed", F.explode("m.patterns").alias("pattern"), "m.instance")
    new = _confident_mentions(scanned, text_col, materialize(exploded, "pii-mentions"), least_seeds, least_score)
    found = new.select("_row", F.struct("start", "end", F.lit("context").alias("kind")).alias("s"))
    extra = materialize(found.groupBy("_row").agg(F.sort_array(F.collect_set("s")).alias("extra")), "pii-extra")  # as many as a text has mentions
    joined = scanned.drop("_mentions").join(extra, "_row", "left")
    return joined.select(*kept.columns, *results[:5], F.concat("pii_spans", F.coalesce("extra", F.array().cast(f"array<{span}>"))).alias("pii_spans"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first counts, then the longer."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def redact_pii(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The result of find_pii with the spans of text_col redacted and the result columns dropped; a null text stays null."""
    names = found.columns
    at, spans_at = names.index(text_col), names.index("pii_spans")
    kept = [i for i, n in enumerate(names) if n not in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "pii_spans")]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else redact(t, [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.column(at).type) if i == at else batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays(columns, names=[names[i] for i in kept])

    return found.mapInArrow(clean, found.select(*[names[i] for i in kept]).schema)
