"""Byte-level BPE, spelling variants and periodic runs against brute force, SQL and odd rows."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tideline.llm import byte_bpe, periodic_runs, queries, spelling

DOCS = "doc_id long, text string"
CLASHING = ["id", "ids", "data", "n", "word", "runs", "n_words", "position", "whole", "a", "b", "to"]
NAMES = ["op11_byte_bpe", "op12_spelling_variants", "op13_periodic_runs"]


def applied(name, docs):
    return {"op11_byte_bpe": queries.byte_bpe_digests, "op12_spelling_variants": queries.spelling_variants, "op13_periodic_runs": lambda d: queries.periodic_run_digests(queries.with_cycles(d))}[name](docs)


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(byte_bpe.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.load())


ODD_TEXTS = ["", " ", "a" * 100_000, "ab" * 50_000, " " * 3000 + "x", "<unk>⁇▁ ▁\x00\x1c\x85", "don't  stop\r\n\r\n  it's 12³½\t!!", "é" * 500 + "\U0001f600‍́", "<|endoftext|>", "日本語のテキスト" * 200]


@pytest.mark.parametrize("text", ODD_TEXTS, ids=range(len(ODD_TEXTS)))
def test_byte_bpe_of_odd_texts(codec, reference, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_byte_bpe_of_any_text(codec, reference, text):
    assert codec.encode(text).tolist() == reference.encode_ordinary(text)


def test_byte_bpe_of_every_kind_of_character(codec, reference):
    for c in [*range(0x3000), 0xFEFF, 0x1F600, 0x10FFFF]:
        text = f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}!\n {chr(c)}"
        assert codec.encode(text).tolist() == reference.encode_ordinary(text), hex(c)


def test_byte_bpe_forgets_and_stays_right(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    small = byte_bpe.Codec(byte_bpe.load())
    r = np.random.default_rng(1)
    for _ in range(30):
        text = " ".join("".join(r.choice(list("abcdeé"), 1 + int(r.integers(70)))) for _ in range(20))
        assert small.encode(text).tolist() == reference.encode_ordinary(text)
        assert len(small.known) <= 50


def test_byte_bpe_of_other_ranks():
    # Ranks with gaps, and a token that merging can't reach.
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abcd"]
    ranks = [2 * i for i in range(len(tokens))]
    codec = byte_bpe.Codec(byte_bpe.Vocabulary(byte_bpe.serialised(tokens, ranks), ranks, r"\S+|\s+"))
    assert codec.encode("abc abcd xbc").tolist() == [512, 2 * ord("c"), 2 * 32, 516, 2 * 32, 2 * ord("x"), 514]
    with pytest.raises(KeyError):
        codec.decode(np.array([1]))


def test_byte_bpe_query(spark, data, reference):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {g["doc_id"]: g for g in queries.QUERIES["op11_byte_bpe"](spark, data).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = reference.encode_ordinary(text or "")
        g = got[doc_id]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode()))


def test_byte_bpe_ids_and_bytes(spark, reference):
    docs = spark.createDataFrame([(1, "two words"), (2, None), (3, "é")], DOCS)
    ids = byte_bpe.encoded(docs)
    assert {g["doc_id"]: g["ids"] for g in ids.collect()} == {1: reference.encode_ordinary("two words"), 2: [], 3: reference.encode_ordinary("é")}
    parts = ids.union(spark.createDataFrame([(4, [reference.encode_ordinary("é")[0]]), (5, None)], "doc_id long, ids array<int>"))
    assert {g["doc_id"]: g["data"] and bytes(g["data"]) for g in byte_bpe.decoded(parts).collect()} == {1: b"two words", 2: b"", 3: "é".encode(), 4: "é".encode(), 5: None}


def variants_by_brute_force(rows):
    import re

    counts = {}
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            k = h % len(w)
            w = w[:k] + w[k + 1 :] if h % 199 == 0 else w
            counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, found in links.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(links[w]), form[w] and counts[form[w]])
    return out


def variant_rows(df):
    return {g["word"]: (g["form"], g["root"], g["n"], g["n_near"], g["form_n"]) for g in df.collect()}


def test_spelling_variants_against_brute_force(spark):
    r = np.random.default_rng(2)
    base = ["".join(r.choice(list("abÀé"), int(r.integers(6, 9)))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Banana", "bananas", "anana"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = list(base[min(int(r.exponential(4)), len(base) - 1)])
            for _ in range(int(r.choice([0, 0, 0, 0, 1, 2]))):
                k, kind = int(r.integers(len(w))), int(r.integers(3))
                w[k : k + (kind > 0)] = [str(r.choice(list("abÀ")))] if kind < 2 else []
            words.append("".join(w))
        rows.append((i, " ".join(words)))
    want = variants_by_brute_force(rows)
    got = variant_rows(queries.spelling_variants(spark.createDataFrame(rows, DOCS).repartition(7)))
    assert got == want
    assert len(want) > 100 and any(v[0] and v[1] != v[0] for v in want.values()) and any(v[3] > 20 for v in want.values())


def test_spelling_chains_ties_and_repeated_counts(spark):
    counts = [("abcdef", 4000), ("abcdeg", 700), ("abcdhg", 130), ("abxdhg", 20), ("abcde", 99), ("zzzzzz", 5), ("zzzzzy", 30), ("zzzzzx", 30), ("qqqqqq", 3), ("qqqqqq", 3), (None, 9), ("short", 50)]
    got = variant_rows(spelling.variant_groups(spark.createDataFrame(counts, "word string, n long")))
    assert got["abxdhg"] == ("abcdhg", "abcdef", 20, 1, 130)
    assert got["abcdhg"] == ("abcdeg", "abcdef", 130, 2, 700)
    assert got["zzzzzz"] == ("zzzzzx", "zzzzzx", 5, 2, 30)
    assert got["qqqqqq"] == (None, "qqqqqq", 6, 0, None)
    assert set(got) == {"abcdef", "abcdeg", "abcdhg", "abxdhg", "zzzzzz", "zzzzzy", "zzzzzx", "qqqqqq"}


def test_spelling_of_very_long_words(spark):
    long = "ab" * 20_000
    got = variant_rows(spelling.variant_groups(spark.createDataFrame([(long, 50), (long[:-1], 5), (long[:777] + "z" + long[778:], 7)], "word string, n long")))
    assert got[long[:-1]] == (long, long, 5, 1, 50) and got[long][3] == 2


def test_spelling_keys_tell_groups_apart():
    words = ["aaaaaab", "aaaaaba", "abaaaaa", "aaaaaa", "baaaaa"]
    number, position, a, b, whole = spelling.group_keys(words, 6)
    groups = {}
    for k in range(len(number)):
        groups.setdefault((position[k], a[k], b[k]), []).append((words[number[k]], bool(whole[k])))
    assert {frozenset(g) for (p, *_), g in groups.items() if p == -1 and len(g) > 1} == {frozenset({("aaaaaab", False), ("aaaaaba", False), ("abaaaaa", False), ("aaaaaa", True)}), frozenset({("abaaaaa", False), ("baaaaa", True)}), frozenset({("aaaaaab", False), ("aaaaaba", False)})}


def runs_by_brute_force(ids, least=6, times=4):
    found = {}
    n = len(ids)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_sequences(letters):
    r = np.random.default_rng(letters)
    for n in [*range(12), 17, 40, 100, 300]:
        for _ in range(8 if letters > 1 else 1):
            ids = r.integers(0, letters, n)
            assert periodic_runs.maximal_runs(ids) == runs_by_brute_force(ids.tolist()), ids.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12)), max_size=8), st.integers(3, 5))
def test_runs_of_nested_repeats(parts, times):
    ids = [x for part, k in parts for x in part * k]
    assert periodic_runs.maximal_runs(np.array(ids, np.int64), 6, times) == runs_by_brute_force(ids, 6, times)


def test_runs_inside_runs_of_longer_periods():
    for inner in (3, 30, 100, 129):
        for tail in ([1], [1, 2], [1, 0, 0, 1]):
            ids = ([0] * inner + tail) * 5 + [7] + ([0, 1] * inner + [2]) * 6
            assert periodic_runs.maximal_runs(np.array(ids)) == runs_by_brute_force(ids)


def test_runs_in_linear_time():
    import time

    r = np.random.default_rng(3)
    block = r.integers(0, 1000, 20_000)
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 200_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for ids in (np.zeros(300_000, np.int64), np.tile(block, 12), r.integers(0, 2, 300_000), np.array(fibonacci[1]), np.tile(np.append(np.zeros(20_000, np.int64), 1), 10)):
        began = time.time()
        periodic_runs.maximal_runs(ids)
        assert time.time() - began < 60
    assert (0, 240_000, 20_000) in periodic_runs.maximal_runs(np.tile(block, 12))


def test_runs_need_three_periods():
    with pytest.raises(ValueError):
        periodic_runs.maximal_runs(np.zeros(9, np.int64), 6, 2)


def run_digest(doc_id, text):
    words = [w.encode() for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_brute_force(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    return (
        len(runs), *(best if best else (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_periodic_runs_query_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(r.choice(list("abcdefgh") + ["é x"], int(r.integers(0, 120))))) for i in range(200)]
    rows += [(1000, "x\t\ty\n" * 9), (1001, "a a a a a"), (1002, "a a a a a a"), (1003, None), (None, "b " * 30), (1003, "           ")]
    got = applied("op13_periodic_runs", spark.createDataFrame(rows, DOCS)).collect()
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(((g["doc_id"], *[g[c] for c in columns]) for g in got), key=str) == sorted(((i, *run_digest(i, t)) for i, t in rows), key=str)
    assert sum(g["n_runs"] > 0 for g in got) >= 10


def test_periodic_runs_and_their_text(spark):
    docs = spark.createDataFrame([(1, "go on a b c a b c a b c a b c a stop")], DOCS)
    got = periodic_runs.periodic_runs(docs).collect()[0]
    assert [tuple(x) for x in got["runs"]] == [(2, 13, 3)] and got["text"] == "go on a b c stop" and got["n_words"] == 16


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_empty_tables(spark, name):
    r = np.random.default_rng(5)
    rows = [(1, "same words here again"), (1, "same words here again"), (2, None), (3, ""), (4, " \t\r\n\n"), (None, "spelling spelling " * 9), (5, " ".join(r.choice(["alpha", "beta", "gammas"], 30_000))), (6, "é " * 50 + "\U0001f600"), (7, "x" * 200_000)]
    docs = spark.createDataFrame([(*x, *["z"] * len(CLASHING)) for x in rows], DOCS + "".join(f", `{c}` string" for c in CLASHING))
    got = applied(name, docs).collect()
    if name == "op12_spelling_variants":
        assert {g["word"] for g in got} == {"gammas", "spelling"}
    else:
        assert sorted(str(g["doc_id"]) for g in got) == sorted(str(i) for i, _ in rows)
    assert applied(name, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", NAMES[1:])
def test_queries_match_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = c.execute(queries.ORACLES[name]).to_arrow_table().to_pylist()
    got = [g.asDict() for g in queries.QUERIES[name](spark, data).collect()]
    columns = sorted(want[0])
    assert sorted(got[0]) == columns
    assert sorted(([g[x] for x in columns] for g in got), key=str) == sorted(([w[x] for x in columns] for w in want), key=str)
