"""The pipeline, stage by stage and as a whole, against a plain version."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from slotwise.llm import sql
from tests.llm import test_jaccard
from tests.llm.test_llm import plain_ids, plain_pii
from tests.llm.test_queries import DOCUMENTS, write


def make_documents():
    rng = random.Random(12)
    words = [f"word{i}" for i in range(400)] + ["größe,", "of", "the"]
    rows = [(None, "en", "a"), ("", "en", "b"), ("too short", "en", "a"), ("again " * 60, "en", "b"), ("## $$ " * 40, "en", None)]
    for i in range(40):
        base = rng.choices(words, k=rng.choice([30, 80, 200]))
        rows.append((" ".join(base), "en", rng.choice(["a", "b", "c", None])))
        if i % 3 == 0:  # an exact copy and a near one
            rows.append((" ".join(base), "de", rng.choice(["a", "c"])))
            rows.append((" ".join([*base[:-1], "other"]), "en", "c"))
        if i % 4 == 0:
            rows.append((" ".join([*rng.choices(words, k=40), f"mail m{i}@x.org or 10.1.2.{i}, 4111 1111 1111 1111"]), "en", "b"))
    return [(i, t, lang, source, len(t or "")) for i, (t, lang, source) in enumerate(rows)]


def plain_quality(documents, folder):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    kept = {i for (i,) in c.execute(f"SELECT doc_id FROM ({sql.ORACLE['op2_quality']}) WHERE kept").fetchall()}
    return [d for d in documents if d[0] in kept]


def plain_dedup(documents):
    stay = set(test_jaccard.plain([d[1] for d in documents]))
    return [d for i, d in enumerate(documents) if i in stay]


def plain_redaction(documents):
    out = []
    for i, text, lang, source, _ in documents:
        for a, b, kind in sorted(plain_pii(text), reverse=True):
            text = f"{text[:a]}<{kind}>{text[b:]}"
        out.append((i, text, lang, source, len(text)))
    return out


def plain_mix(documents):
    sizes, total = Counter(), 0
    for d in documents:
        sizes[d[3]] += len(d[1].split())
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    stopped: set = set()
    while True:
        open_ = [s for s in names if s not in stopped]
        level = (total - sum(3 * sizes[s] for s in stopped)) / sum(weights[s] for s in open_) if open_ else 0
        more = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    out = []
    for s in names:
        left = 3 * sizes[s] if s in stopped else int(weights[s] * level)
        mine = sorted((d for d in documents if d[3] == s), key=lambda d: (hashlib.md5(f"mix:{d[0]}:{d[1]}".encode()).hexdigest(), d[0]))
        epochs, rest = divmod(left, sizes[s])
        for d in mine:
            n = len(d[1].split())
            out += [d] * epochs
            if rest >= n:
                out.append(d)
            elif rest:
                text = " ".join(d[1].split()[:rest])
                out.append((d[0], text, d[2], d[3], len(text)))
            rest = max(0, rest - n)
    return out


@pytest.fixture(scope="module")
def documents():
    return make_documents()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, documents):
    d = tmp_path_factory.mktemp("pipeline")
    write(d, "documents", list(zip(*documents)), DOCUMENTS)
    return str(d)


def counted(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def check_packed(rows, documents):
    """Pieces of the documents' ids (equal documents any number of times), gapless in their sequences."""
    want = Counter((d[0], len(plain_ids("byte_bpe_50k.json", d[1])), zlib.crc32(plain_ids("byte_bpe_50k.json", d[1]).tobytes())) for d in documents)
    sequences, tokens = defaultdict(list), Counter()
    for r in rows:
        sequences[r.sequence_id].append(r)
        tokens[r.doc_id, r.doc_tokens] += r.length
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    ids = {(d[0], len(plain_ids("byte_bpe_50k.json", d[1]))): plain_ids("byte_bpe_50k.json", d[1]) for d in documents}
    assert all(zlib.crc32(ids[r.doc_id, r.doc_tokens][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    totals = Counter()
    for (i, n, _), times in want.items():
        totals[i, n] += n * times
    assert tokens == totals


def test_stages_and_the_whole(spark, documents, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    steps = [("quality_rules", plain_quality(documents, folder))]
    steps.append(("simhash_near_dedup", plain_dedup(steps[-1][1])))
    steps.append(("pii", plain_redaction(steps[-1][1])))
    steps.append(("mixing", plain_mix(steps[-1][1])))
    assert [len(d) for _, d in steps] == sorted((len(d) for _, d in steps[:3]), reverse=True) + [len(steps[-1][1])] and 20 < len(steps[1][1]) < len(steps[0][1]) < len(documents)
    before = documents
    for name, want in steps:
        docs = spark.createDataFrame(before, table.schema).repartition(3)
        assert counted(stages[name](spark, docs, folder)) == Counter(want), name
        before = want
    shared = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    files = shared.getFileSystem(spark._jsc.hadoopConfiguration())
    had = {f.getPath().getName() for f in files.listStatus(shared)}
    check_packed(corpus_pipeline.run(spark, folder).collect(), before)
    left = {f.getPath().getName() for f in files.listStatus(shared)} - had
    assert len(left) == 1 and left.pop().startswith("stage-packing")  # nothing but its result


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_stages_called_one_on_the_other(spark, documents, folder):
    """No stage takes away what an earlier result, written or not, is still read from; results can be read in any order and again."""
    table = spark.read.parquet(f"{folder}/documents.parquet")
    docs, results = spark.createDataFrame(documents, table.schema).repartition(3), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        results.append(docs)
    wanted = plain_quality(documents, folder)
    want = [wanted, plain_dedup(wanted)]
    want.append(plain_redaction(want[-1]))
    want.append(plain_mix(want[-1]))
    check_packed(results[4].collect(), want[3])
    for got, rows in list(zip(results, want))[::-1]:
        assert counted(got) == Counter(rows)
    assert counted(results[1]) == Counter(want[1])
