"""Quality rules as a short-circuit cascade.

A rule rejects a text or lets it pass. The cascade keeps a text that no rule rejects, so the order
of the rules does not change which texts are kept, only what it costs: each rule's cost and
rejections are measured on a sample of the texts, and rules run by rejections per cost, the
best first, until one rejects. A cost is what a rule adds to the features that are wanted of
every text in any case, since no order of the rules can save those.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import extended, without, words_of

# Fixed values of the base features.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
REPEAT_WINDOW = 8


def repeated_words(words: list, size: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `size` words whose sequence is found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter(map(number.setdefault, words, count()), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    key = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    for j in range(size):  # equal keys, but are the words equal?
        if not (ids[a + j] == ids[b + j]).all():
            groups: dict = {}
            for i in range(n):
                groups.setdefault(tuple(ids[i : i + size]), []).append(i)
            a = np.array([i for g in groups.values() if len(g) > 1 for i in g], dtype=np.int64)
            b = a
            break
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.unique(np.concatenate([a, b]))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


class Features:
    """A text's features, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_upper(self) -> int:
        return sum(w.decode().isupper() for w in self.words)

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter."""
        return sum(any(map(str.isalpha, w.decode())) for w in self.words)

    @cached_property
    def n_ascii_words(self) -> int:
        """Words of the letters A-Z and a-z alone."""
        return sum(map(bytes.isalpha, self.words))

    @cached_property
    def n_ascii_lower(self) -> int:
        """Words with a letter a-z and none A-Z."""
        return sum(map(bytes.islower, self.words))

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: Whatever the cascade says, a text is rejected for too few words or too many repeated ones.
BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 20),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 30 * f.n_words),
)
RULES = (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("long_words", lambda f: f.word_chars > 25 * f.n_words),
    Rule("short_words", lambda f: f.word_chars < 2 * f.n_words),
    Rule("repeated_lines", lambda f: f.n_dup_lines > 3 and 10 * f.n_dup_lines > 3 * len(f.lines)),
    # The first halves are bounds that cost little and settle most texts.
    Rule("capitals", lambda f: 2 * (f.n_words - f.n_ascii_lower) > f.n_words and 2 * f.n_upper > f.n_words),
    Rule("few_letters", lambda f: 2 * f.n_ascii_words < f.n_words and 2 * f.n_lettered < f.n_words),
    Rule("few_distinct", lambda f: f.n_words >= 100 and 20 * f.n_distinct < f.n_words),
)


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


#: What is given out for every text, and so is computed whatever the rules say.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure_rules(texts: list[str | None], rules=RULES, wanted: tuple[str, ...] = FEATURES) -> list[Measured]:
    """Each rule's seconds a text beyond the features that are wanted anyway, and share of texts rejected."""
    out = []
    for rule in rules:
        fresh = [Features(t) for t in texts]
        for f in fresh:
            for name in wanted:
                getattr(f, name)
        began = time.perf_counter()
        rejected = sum(map(rule.rejects, fresh))
        out.append(Measured(rule.name, (time.perf_counter() - began) / max(1, len(texts)), rejected / max(1, len(texts))))
    return out


def order_rules(measured: list[Measured]) -> list[str]:
    """Names by rejections per cost, the best first; of rules that reject nothing, the cheaper first."""
    return [m.name for m in sorted(measured, key=lambda m: (-m.worth, m.seconds, m.name))]


def measure_sample(docs: DataFrame, rules=RULES, sample_rows: int = 400, seed: int = 17, text_col: str = "text") -> list[Measured]:
    """The rules measured on at most sample_rows texts, in the tasks that read them; only figures reach the driver.

    They decide the order of the rules alone, never a verdict. The sample is drawn at random, but if
    there are more than sample_rows, the first partitions' come first.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure_rules(batch.column(0).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([pa.array([m.name for m in found], pa.string()), pa.array([m.seconds * batch.num_rows for m in found], pa.float64()), pa.array([m.rejected * batch.num_rows for m in found], pa.float64()), pa.array([float(batch.num_rows)] * len(found), pa.float64())], names=["name", "seconds", "rejected", "n"])

    sample = docs.select(text_col).where(F.rand(seed) < 0.2).limit(sample_rows)
    sums: dict[str, list[float]] = {r.name: [0.0, 0.0, 0.0] for r in rules}
    for row in sample.mapInArrow(measure, "name string, seconds double, rejected double, n double").collect():
        sums[row.name] = [a + b for a, b in zip(sums[row.name], (row.seconds, row.rejected, row.n), strict=True)]
    return [Measured(name, seconds / max(1.0, n), rejected / max(1.0, n)) for name, (seconds, rejected, n) in sums.items()]


def apply_quality(docs: DataFrame, rules=RULES, sample_rows: int = 400, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    The five features are wanted of every text, so rules that use only those cost next to nothing and mostly come
    first; what others need (capitals, letters, distinct words) is computed only for texts that all
    rules before let pass. A null or empty text has no words and fails the base rules; repeated rows
    are judged each; columns of docs named like a result are replaced. Narrow, no shuffle.
    """
    kept = without(docs, [*FEATURES, "base_failed", "kept"])
    schema = extended(kept.schema, ", ".join(f"{n} long" for n in FEATURES) + ", base_failed boolean, kept boolean")
    order = order_rules(measure_sample(docs, rules, sample_rows, text_col=text_col))
    at = kept.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in rules}
        cascade = [by_name[n] for n in order]
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(FEATURES) + 2)]
            for text in batch.column(at).to_pylist():
                f = Features(text)
                failed = any(r.rejects(f) for r in BASE_RULES)
                for column, value in zip(columns, [*(getattr(f, n) for n in FEATURES), failed, not failed and not any(r.rejects(f) for r in cascade)], strict=True):
                    column.append(value)
            more = [pa.array(c, pa.int64()) for c in columns[:-2]] + [pa.array(c, pa.bool_()) for c in columns[-2:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *FEATURES, "base_failed", "kept"])

    return kept.mapInArrow(judge, schema)
