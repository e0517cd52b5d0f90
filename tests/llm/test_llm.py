"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats, clashing columns; and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slotwise.llm import ann, chat, mixing, packing, pii, quality, secrets, simhash, simple8b, substrings, token_store
from slotwise.llm.tokens import ChunkedTokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, spans string"
RNG = random.Random(4)
WORDS = ["the", "of", "Réaile", "and", "onble,", "thnt.", "AKIA", "x" * 30, "größe", "to"]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) + str(RNG.randint(0, 9)) * RNG.randint(0, 1) for _ in range(n))


PASSAGE = prose(60)
TEXTS = [None, "", "  \n", "one", prose(30), prose(400), PASSAGE, PASSAGE, f"{prose(20)} {PASSAGE} {prose(9)}", "na " * 120, 'token = "abcdef0123" ' + "0123456789abcdef" * 4, "mail a.b+c@x-y.org or 10.0.0.255, 4111 1111 1111 1111; +1 (555) 010-9999.", prose(5000), prose(30), "#|*$ " * 40, "İΣ ß'S it's   tab\t  end "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, True, 1, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[5:6], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(rows, value):
    return Counter((r.text, value(r)) for r in rows)


def all_texts():
    return [*TEXTS, TEXTS[5]]


def test_secrets(docs, none):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = by_text(secrets.scan_secrets(docs, *args).collect(), lambda r: tuple(tuple(s) for s in r.secret_spans if s[2] != "random"))
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)

    def plain(t):
        t = t or ""
        found = [(m.start(), m.end(), "assign") for m in pattern.finditer(t) if len(m[2]) >= 6] + [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return tuple(sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2]))))

    assert got == Counter((t, plain(t)) for t in all_texts()) and secrets.scan_secrets(none, *args).count() == 0
    ratio = secrets.TokenRatio(*args)
    assert [k for *_, k in secrets.scan_text("id zQ3vX9kLm2TbR7yWp4Nd8Hs6 d41d8cd98f00b204e9800998ecf8427e internationalization-of-things-2024", ratio)] == ["random", "hex"]


def test_secrets_letters_short_and_glued():
    ratio = secrets.TokenRatio(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(11)

    def draw(letters, n):
        return "".join(rng.choices(letters, k=n))

    def found(text):
        return [text[a:b] for a, b, k in secrets.scan_text(text, ratio) if k == "random"]

    lower, both = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = both + "0123456789"
    for letters, n, least in ((both, 40, 100), (mixed, 16, 100), (mixed, 24, 100), (lower, 40, 95)):  # lower-case strings have ratios of up to 2
        assert sum(len(found(f"id {draw(letters, n)} end")) == 1 for _ in range(100)) >= least, (letters, n)
    for _ in range(50):
        key = draw(mixed, 24)
        for text in (f"database_connection_credentials={key}", f"internal/documentation/{key}/configuration", f"configuration{key}", f"configurationconfiguration{key.lower()}", f"the-secret-of-{key[:12]}/{key[12:]}"):
            assert found(text), text
    assert found("internationalization-of-things-2024 20241128050000123456 request/550e8400-E29B-41d4-a716-446655440000/documentation to_be_or_not_to_be_that_is_the_question internationalization") == []


def test_secrets_where_many_spans_meet():
    ratio = secrets.TokenRatio(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    keys = ["".join(rng.choices("abcdefghijkXYZ0123456789", k=20)) for _ in range(10_000)]
    began = time.perf_counter()
    found = secrets.scan_text(" ".join(f"token={k} {k[::-1]}" for k in keys), ratio)
    assert time.perf_counter() - began < 5 and sum(k == "assign" for *_, k in found) == 10_000 and sum(k == "random" for *_, k in found) > 9_000


def test_quality(docs, none):
    rows = quality.apply_quality(docs).collect()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        places: dict = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        repeated = len({i + j for p in places.values() if len(p) > 1 for i in p for j in range(8)})
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), repeated)
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", r.text or "")), sum(x in lines[:i] for i, x in enumerate(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * repeated > 30 * len(w)) and not (r.kept and r.base_failed)
    assert len(rows) == len(all_texts()) and quality.apply_quality(none).count() == 0
    m = [quality.Measured("a", 1.0, 0.1), quality.Measured("b", 0.1, 0.1), quality.Measured("c", 0.2, 0.0)]
    assert quality.order_rules(m) == ["b", "a", "c"]


def test_quality_order_follows_what_a_rule_adds(docs):
    calls = Counter()

    def slow(f):
        calls["slow"] += 1
        return time.sleep(0.0005) or f.n_words % 2 == 0

    rules = (quality.Rule("slow", slow), quality.Rule("wanted_anyway", lambda f: f.n_repeat_words > 10), quality.Rule("never", lambda f: False))
    texts = [prose(300) for _ in range(20)] + ["na " * 500] * 20
    found = quality.measure_rules(texts, rules)
    assert quality.order_rules(found) == ["wanted_anyway", "slow", "never"] and calls["slow"] == 40
    by_name = {m.name: m for m in found}
    assert by_name["wanted_anyway"].seconds < 1e-4 and by_name["wanted_anyway"].rejected == 0.5  # its feature is not counted
    assert [m.name for m in quality.measure_sample(docs, quality.RULES)] == [r.name for r in quality.RULES]
    for r in quality.RULES:  # every rule turns something down
        assert r.rejects(quality.Features({"symbols": "# a", "long_words": "x" * 30, "short_words": "a b", "repeated_lines": "a\n" * 9 + "b", "capitals": "AB CD", "few_letters": "1 2 a", "few_distinct": "a " * 100}[r.name]))


def test_substrings(docs, none):
    words = [(t or "").encode().split() for t in all_texts()]
    counts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))

    def plain(w):
        gone = {i + j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(35)}
        return len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()

    got = Counter((r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect())
    assert got == Counter(map(plain, words)) and substrings.remove_repeats(none).count() == 0


def test_substrings_write_few_tables(spark, monkeypatch):
    """Each file that is written costs an executor processes of its own, so copies are counted with the texts and with the starts, not in tables of their own."""
    labels = []
    write = substrings.materialize

    def counted(df, label, *a):
        labels.append(label)
        return write(df, label, *a)

    monkeypatch.setattr(substrings, "materialize", counted)
    rng = random.Random(21)
    shared = [f"s{rng.random()}" for _ in range(40)]
    alone = lambda n: [f"a{rng.random()}" for _ in range(n)]
    one = " ".join(alone(20) + shared + alone(20))
    texts = [(1, one), (2, one), (3, one), (4, " ".join(alone(5) + shared)), (5, " ".join(alone(50))), (6, "few words"), (7, "few words"), (8, None), (9, "")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: (80, 80), 2: (80, 80), 3: (80, 80), 4: (45, 40), 5: (50, 0), 6: (2, 0), 7: (2, 0), 8: (0, 0), 9: (0, 0)}
    assert len(labels) <= 6


def test_marks_of_windows():
    """Equal windows have equal marks; a phrase of long words in other surroundings shares none, so no window is sent for it."""
    rng = random.Random(8)

    def marks(words):
        return substrings.window_marks(*substrings.hashed_words(" ".join(words)))[0].tolist()

    for letters in ("ab", "abcdefgh", [f"w{i}" * (1 + i % 3) for i in range(500)]):
        found = {}
        stretch = rng.choices(letters, k=60)
        for _ in range(30):
            words = rng.choices(letters, k=rng.randrange(40)) + stretch + rng.choices(letters, k=rng.randrange(40))
            for i, mark in enumerate(marks(words)):
                assert found.setdefault(tuple(words[i : i + 35]), mark) == mark
    for n in range(20):
        phrase = [f"p{n}-{i}" * (1 + 5 * (7 <= i < 9)) for i in range(16)]
        one, other = ([f"{k}{i}" for i in range(40)] + phrase + [f"{k}{i}" for i in range(40, 80)] for k in "xy")
        assert not set(marks(one)) & set(marks(other))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    assert simple8b.decode(simple8b.encode(v), len(v)).tolist() == values


LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def plain_ids(name, text):
    """By the library as it comes, with nothing set."""
    return np.array([*LIBRARY[name].encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "\n\n", "  ", "it's", "don't,", "Ünï.", "<|endoftext|>", "é"])), max_size=12).map("".join))
def test_chunked_ids_equal_whole_ids(text):
    for name, chunks in (("word_bpe_49k.json", "bare"), ("byte_bpe_50k.json", "led")):
        key = (name, chunks)
        coder = CODERS.get(key) or CODERS.setdefault(key, ChunkedTokenizer(public_tokenizers.path(name), chunks))
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == plain_ids(name, text)[:-1].tolist()


CODERS: dict = {}


def test_special_strings_as_text():
    for name, chunks in (("word_bpe_49k.json", "bare"), ("byte_bpe_50k.json", "led")):
        coder = ChunkedTokenizer(public_tokenizers.path(name), chunks, special_as_text=True)
        assert not {49406, 49407, 50256} & set(np.frombuffer(coder.encode(["a <|endoftext|> b <|startoftext|>"])[0], "<u4").tolist())


def test_bare_words_with_stops_and_capitals_are_found_once():
    """A frequent word with a comma or capitals is one look-up, not the steps to find it each time; ids are the library's."""
    coder, asked = ChunkedTokenizer(public_tokenizers.path("word_bpe_49k.json"), "bare"), []
    find = coder.memo.find
    coder.memo.find = lambda chunk: asked.append(chunk) or find(chunk)
    texts = ["The word, the Word, THE\u00c9 end.\x1fend.\x85 the\u00a0end, \u0130x \u212aelvin, \u00c4,"] * 50
    got = coder.encode(texts)
    assert got == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert len(asked) < 40


def test_token_store(spark, docs, none, tmp_path):
    token_store.write_token_ids(docs, str(tmp_path / "a"), public_tokenizers.path("word_bpe_49k.json"), "bare", 1)
    rows = token_store.read_token_ids(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids) and Counter(r.ids_crc32 for r in rows) == Counter(zlib.crc32(plain_ids("word_bpe_49k.json", t).tobytes()) for t in all_texts())
    token_store.write_token_ids(none, str(tmp_path / "b"), public_tokenizers.path("word_bpe_49k.json"), "bare", 1)
    assert token_store.read_token_ids(spark, str(tmp_path / "b")).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "led", 1, size=256, windows=2, fan_in=2, keep_ids=True).collect()
    lengths = Counter()
    # Each document's pieces, one after another, are the library's ids; equal ids (null) are told apart by length.
    whole: dict = {}
    for r in sorted(rows, key=lambda r: r.start):
        whole.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(r.ids)
    want = Counter(plain_ids("byte_bpe_50k.json", t).tobytes() for t in all_texts())
    copies = {k: len(v[0]) for k, v in whole.items()}
    got = Counter()
    for k, v in whole.items():
        if copies[k] == 1:
            got[b"".join(p[0] for _, p in sorted(v.items()))] += 1
    assert all(want[ids] >= n for ids, n in got.items()) and sum(got.values()) >= len(want) - 2
    for r in rows:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
        lengths[r.sequence_id] += r.length
    assert all(n <= 256 and n & (n - 1) == 0 for n in lengths.values())
    for s in lengths:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert sum(lengths.values()) == sum(len(plain_ids("byte_bpe_50k.json", t)) for t in all_texts())
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json"), "led", 1).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    total = sum(r.size for r in rows)
    by_source = {r.source: (r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in by_source.values()) - min(total, 3 * total)) < 1e-6 and all(t <= 3 * s for s, t in by_source.values())
    for source, (_, target) in by_source.items():
        assert sum(r.taken for r in rows if r.source == source) == int(target)
    assert all(r.taken <= 3 * r.size for r in rows) and len(rows) == len(all_texts()) and mixing.mix_sources(none).count() == 0


def test_mixing_of_rows_that_differ_in_a_carried_column_only(spark, monkeypatch):
    rows = [(1, "one two three four five", "a", f"lang{i}") for i in range(30)] + [(2, "six seven", "b", "x"), (3, None, None, None)]
    first = None
    for parts, per_range in ((1, 20_000), (7, 20_000), (3, 1)):
        monkeypatch.setattr(mixing, "RANGE_ROWS", per_range / 4096)
        docs = spark.createDataFrame(random.sample(rows, len(rows)), "doc_id long, text string, source string, lang string").repartition(parts)
        got = sorted((r.doc_id, r.lang or "", r.taken) for r in mixing.mix_sources(docs, carry=("lang",)).collect())
        first = first or got
        assert got == first and len(got) == 32


PII_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    """Base spans by the patterns as they are stated."""

    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.split("."))
        if kind == "card":
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(m.start(), m.end(), kind) for kind, p in PII_PATTERNS.items() for m in re.finditer(p, text or "") if holds(kind, m[0])]


def test_pii(spark, docs, none):
    tricky = ["a@b.co_m@x.yz @q a@b a..b@c.d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 1.2.3", "@" * 50, "9" * 5000 + ".1.1.1", "4111-1111 1111-1111, 4111 1111 1111 1112 4222222222222222229 +1.(2)-3 4 5 6 7 8 +12345678901234567 ++49 30 1234567", "x4111111111111111x +4111111111111111"]
    rng = random.Random(8)
    fuzz = ["".join(rng.choice("0123456789 .-+()@aB\n") for _ in range(80)) for _ in range(300)]
    for text in [*filter(None, TEXTS), *tricky, *fuzz]:
        assert pii.base_spans(text) == plain_pii(text)
    rows = pii.find_pii(docs).collect()
    assert Counter((r.text, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == Counter(
        (t, *(sum(k == kind for *_, k in plain_pii(t)) for kind in PII_PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in plain_pii(t)).encode()).hexdigest()) for t in all_texts()
    )
    cleaned = pii.redact_pii(pii.find_pii(docs)).collect()
    assert "a.b+c" not in "".join(r.text or "" for r in cleaned) and None in [r.text for r in cleaned]
    assert pii.find_pii(none).count() == 0 and pii.redact_pii(pii.find_pii(none)).count() == 0
    # Columns named like results are replaced.
    clash = spark.createDataFrame([(1, "a@b.cd", "x", 5)], "doc_id long, text string, PII_spans string, n_email long")
    assert [(r.n_email, [s.kind for s in r.pii_spans]) for r in pii.find_pii(clash).collect()] == [(1, ["email"])]


def test_pii_context_of_any_form(spark):
    values = ["DE89 3704 0044 0532 0130 00", "12 345 678", "jdoe12", "Ünal-4471", "A" * 45 + "7", "12345678!", "12345678?", "<12345678>", "«12345678»", "12345678###", "quillfeather"]
    said = [(i, f"my account id: user{i}@mail.org thanks") for i in range(90)] + [(100 + i, f"my account id: {v} thanks") for i, v in enumerate(values)] + [(200, "my account id: unknown thanks")]
    said += [(300 + i, f"word{'abcdefghi'[i]} of unknown quality, thanks to room 12 and jdoe13") for i in range(9)] + [(400, "room of 77120935 people")]
    rows = {r.doc_id: (r.text, [(s.start, s.end) for s in r.pii_spans if s.kind == "context"]) for r in pii.find_pii(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    got = [[text[a:b] for a, b in spans] for text, spans in (rows[100 + i] for i in range(len(values)))]
    assert got == [[v.strip("!?<>«»#")] for v in values]
    assert rows[200][1] == [] and rows[400][1] == [] and all(rows[300 + i][1] == [] for i in range(9))


def test_pii_bootstraps_until_nothing_is_new(spark):
    """Seeds vouch for numbers, the numbers for a second pattern, that for further numbers, and so on: a chain of five."""
    links = ["write to agent", "signed by officer", "sent from desk", "filed under person", "known as member"]
    names = [[f"qz-{i}{j}7" for j in range(5)] for i in range(5)]
    said = [f"please {links[0]} u{j}@x.org, thanks" for j in range(20)]
    for i, pattern in enumerate(links):
        said += [f"please {pattern} {n}, thanks" for n in names[i]]
        said += [f"again {links[i + 1]} {n}, thanks" for n in names[i]] * 1 if i < 4 else []
    table = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    found = {r.text[s.start : s.end] for r in pii.find_pii(table, least_score=0.45).collect() for s in r.pii_spans if s.kind == "context"}
    assert found >= {n for chain in names for n in chain}


def test_pii_long_texts():
    began = time.perf_counter()
    for text in (" ".join(f"id: {i}, u{i}@x.org" for i in range(20_000)), ",".join(f"u{i}@x.org" for i in range(20_000)), "x" * 1_000_000 + " 1", "((" * 500_000 + "1"):
        base = pii.base_spans(text)
        pii.mentions(text, base)
        full = bytes([255]) * (1 << pii.BITS - 3)
        finder = pii.PlainWords(full, full, full, [full])
        for _, _, patterns, instance in finder.mentions(text, base):
            list(finder.new_pairs(patterns, instance))
    assert time.perf_counter() - began < 20


def test_bitmap(spark):
    keys = [f"key {i} é" for i in range(5000)]
    none, bits = pii.bitmaps(spark.createDataFrame([(1, k) for k in keys], "kind int, key string"), 2)
    assert all(pii.holds(bits, k) for k in keys) and sum(pii.holds(bits, f"other {i}") for i in range(5000)) < 5
    assert not any(none) and not any(pii.bitmaps(spark.createDataFrame([], "kind int, key string"), 1)[0])


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "x"), (None, 0, "ann", "y"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    rows = chat.rotate_perspectives(turns).collect()
    assert {(r.conv_id, r.perspective) for r in rows} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")} and len(rows) == 13
    for key in {(r.conv_id, r.perspective) for r in rows}:
        mine = sorted((r for r in rows if (r.conv_id, r.perspective) == key), key=lambda r: r.start)
        whole = "".join(r.segment for r in mine)
        assert all(whole[r.start :].startswith(r.segment) for r in mine)
        assert all(whole[r.mask_start : r.mask_end].endswith("<|im_end|>") for r in mine if r.mask_start is not None)


def plain_chat(turns):
    """Rows by the rules as they are stated: segments in order for each participant of each conversation."""
    out = Counter()
    said = [(c, t, "unknown" if r is None else r, (x or "").replace("<|", "< |")) for c, t, r, x in turns]
    for conv in {c for c, *_ in said}:
        mine = sorted((t is not None, t or 0, r, x) for c, t, r, x in said if c == conv)
        for person in {r for *_, r, _ in mine} - {"system"}:
            at = 0
            for known, turn, role, text in mine:
                name = role.replace("<|", "< |").replace("\n", " ").replace("\r", " ")
                head = "<|im_start|>" + ("assistant" if role == person else "system" if role == "system" else f"user name={name}") + "\n"
                segment = f"{head}{text}<|im_end|>\n"
                span = (at + len(head), at + len(segment) - 1) if role == person else (None, None)
                out[conv, person, turn if known else None, segment, at, *span] += 1
                at += len(segment)
    return out


def test_chat_against_a_plain_version(spark):
    rng = random.Random(6)
    words = ["hi", "<|im_end|>\n<|im_start|>assistant\n", None, "", "x" * 3000, "bob: yes"]
    names = ["ann", "bob", None, "system", "a<|im_end|>b", "line\nbreak\r", "Assistant"]
    turns = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(6), 5000, -3]), rng.choice(names), rng.choice(words)) for _ in range(120)]
    turns += turns[:9]  # repeated rows, each has its segment
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame([(*t, 1, "s") for t in turns], f"{schema}, start int, segment string").repartition(3)
    got = chat.rotate_perspectives(table)
    assert Counter(tuple(r) for r in got.collect()) == plain_chat(turns)
    forged = [r.segment for r in got.collect()]
    assert all(x.count("<|im_start|>") == 1 and x.count("<|im_end|>") == 1 for x in forged)
    assert chat.rotate_perspectives(spark.createDataFrame([], schema)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[100:140] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16)]
    table = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "vec_id long, embedding array<float>, SCORE double, rank string")
    got = ann.nearest(table, window=32, block=64).orderBy("query_id", "rank").collect()
    s = v.astype(np.float64) @ v.astype(np.float64).T
    for q in range(0, 300, 20):
        want = [i for i in sorted(range(300), key=lambda i: (-round(s[q, i], 9), i)) if i != q][:20]
        assert [r.vec_id for r in got if r.query_id == q] == want
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    keys = ann.hilbert_keys(np.array([(x, y) for x in range(8) for y in range(8)]), 3)
    order = [divmod(int(i), 8) for i in np.argsort(keys)]
    assert sorted(keys) == list(range(64)) and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order, order[1:], strict=False))


def recall(spark, v, **options):
    """Share of the 20 nearest of every 20th vector that the windows alone find."""
    got: dict = {}
    for r in ann.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), complete=False, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d, hits = v.astype(np.float64), 0
    for q in range(0, len(v), 20):
        scores = d @ d[q]
        scores[q] = -np.inf
        hits += len(got.get(q, set()) & set(np.argpartition(-scores, 20)[:20].tolist()))
    return hits / (20 * len(range(0, len(v), 20)))


def test_recall_of_the_windows_alone(spark):
    rng = np.random.default_rng(9)
    flat = rng.normal(size=(4000, 64)).astype(np.float32)
    centres = rng.normal(size=(60, 64))
    grouped = (centres[rng.integers(0, 60, 6000)] + 0.35 * rng.normal(size=(6000, 64))).astype(np.float32)
    assert recall(spark, grouped, window=256) >= 0.9  # 4 windows of 512 among 6000
    assert recall(spark, flat) >= 0.9  # 4 windows of 2048 among 4000 without any structure
    assert recall(spark, flat, window=256) < 0.7  # which is why the exact check follows


def test_fewer_candidates_than_asked_for(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5]), (40, [0.0, 2.0]), (41, [0.5, 0.5])], "vec_id long, embedding array<double>")
    for complete in (True, False):
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(table, complete=complete).orderBy("query_id", "rank").collect()]
        assert got == [(20, 1, 21, 0.5), (20, 2, 41, 0.5), (20, 3, 40, 0.0), (40, 1, 21, 1.0), (40, 2, 41, 1.0), (40, 3, 20, 0.0)]


def test_nearest_of_scaled_vectors():
    rng = np.random.default_rng(5)
    for scale in (1e-12, 1.0, 1e3, 1e12):
        v = (scale * rng.normal(size=(400, 64))).astype(np.float32).astype(np.float64)
        _, _, scores = ann._best(v, v, np.full(400, -np.inf), 21)
        floors = np.array([sorted(s)[-21] for s in np.array_split(np.array(scores), np.flatnonzero(np.diff(ann._best(v, v, np.full(400, -np.inf), 21)[0])) + 1)])
        rows, _, _ = ann._best(v, v, floors, 21)
        assert np.bincount(rows, minlength=400).min() >= 21, scale
        # At small scales a fixed tolerance would let every vector through.
        assert np.bincount(rows, minlength=400).max() < 40, scale


def test_anchors_cover():
    code = simhash._golay()
    assert np.bitwise_count(code[1:]).min() == 7
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    rx, kx, hx = simhash.anchors_of(x)
    ry, ky, _ = simhash.anchors_of(y)
    homes, near = {(r, k) for r, k, h in zip(rx, kx, hx, strict=True) if h}, set(zip(ry, ky, strict=True))
    assert {r for r, _ in homes & near} == set(range(500))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """The smallest node reachable of each."""
    low = {x: x for x in nodes}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            p, q = sorted((root(a), root(b)))
            low[q] = p
    return {x: root(x) for x in nodes}


def test_near_duplicates(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    fps = {t: simhash.fingerprint(t) for t in all_texts()}
    assert fps == {t: plain_fingerprint(t) for t in fps} and fps[None] == fps[""] == 0 and len(rows) == len(all_texts())
    groups = Counter(r.component_id for r in rows)
    assert groups[0] >= 3 and next(r.component_id for r in rows if r.doc_id == 7) == next(r.component_id for r in rows if r.doc_id == 6)
    kept = simhash.deduplicate(docs).collect()
    assert len(kept) == len(groups) and simhash.near_duplicates(none).count() == 0


def near_texts():
    """Families of texts that differ in a word or two, so that fingerprints of a family are within a few bits; some twice."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", "one"]
    for n in (30, 90, 300):
        for _ in range(8):
            base = rng.choices(words, k=n)
            for _ in range(6):
                base = list(base)
                base[rng.randrange(n)] = rng.choice(words).upper()
                texts.append(" ".join(base))
            texts.append(texts[-1])
    return texts


def test_components_of_fingerprints_against_all_pairs(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i + 5, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id string").repartition(3)
    prints = {i + 5: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert len(set(want.values())) < len(set(prints.values())) < len(prints)  # some fingerprints are linked, some equal
    assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {i: (prints[i], want[i]) for i in prints}


@pytest.mark.parametrize("tile", [50, 4096])
def test_links_of_random_near_fingerprints_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(25)}
    want = components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    signed = {p: p - (1 << 64) * (p >> 63) for p in prints}
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed.values()], "fp long")).collect()
    pairs = {frozenset((r.a, r.b)) for r in links}
    got = components(signed.values(), lambda a, b: frozenset((a, b)) in pairs)
    assert {frozenset(p for p in prints if want[p] == r) for r in want.values()} == {frozenset(p for p in prints if got[signed[p]] == r) for r in got.values()}


def test_group_links_of_a_large_group():
    rng = np.random.default_rng(3)
    prints = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64) | np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64), np.zeros(1, np.uint64)]))
    began = time.perf_counter()
    a, b = simhash.group_links(prints, prints)
    assert len(set(a.tolist()) | set(b.tolist())) == len(prints) and len(a) == len(prints) - 1 and time.perf_counter() - began < 2


def test_results_replace_columns_of_their_names(spark):
    table = spark.createDataFrame([(1, "token = abcdef123 " + "w " * 40, "x", 7, "y", 3.5, "z")], "doc_id long, text string, SECRET_spans string, n_words int, kept_sha256 string, n_symbols double, _t1 string")
    found = secrets.scan_secrets(table, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert found.columns[-1] == "secret_spans" and found.first().secret_spans[0].kind == "assign" and "SECRET_spans" not in found.columns
    stripped = substrings.remove_repeats(table)
    assert (stripped.first().n_words, stripped.first().n_removed) == (43, 40) and stripped.columns.count("n_words") == 1
    judged = quality.apply_quality(table).first()
    assert (judged.n_words, judged.n_symbols) == (43, 0)


def test_one_very_long_text(spark, tmp_path):
    text = prose(120_000)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x" * 300_000)], "doc_id long, text string")
    token_store.write_token_ids(docs, str(tmp_path / "long"), public_tokenizers.path("word_bpe_49k.json"), "bare", 1)
    got = {r.doc_id: r.ids_crc32 for r in token_store.read_token_ids(spark, str(tmp_path / "long")).collect()}
    assert got == {i: zlib.crc32(plain_ids("word_bpe_49k.json", t).tobytes()) for i, t in ((1, text), (2, None), (3, "x" * 300_000))}
    pieces = sorted((r for r in packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "led", 1, keep_ids=True).collect() if r.doc_id == 1), key=lambda r: r.start)
    assert b"".join(bytes(r.ids) for r in pieces) == plain_ids("byte_bpe_50k.json", text).tobytes()
    assert simhash.near_duplicates(docs).count() == 3 and substrings.remove_repeats(docs).count() == 3
