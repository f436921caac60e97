"""The base spans of secret scans against SQL (counts) and plain patterns (spans), on all given documents and on odd texts."""

import hashlib
import re

import duckdb

from tideline.llm import secret_scan

PATTERNS = {  # kind: pattern, group that is measured, least length
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}
SQL = "SELECT doc_id, " + ", ".join(
    f"""len(list_filter(regexp_extract_all(coalesce(text, ''), '{p.replace("'", "''")}', {g}), lambda x: length(x) >= {n})) AS n_{kind}""" for kind, (p, g, n) in PATTERNS.items()
)
ODD = [
    None, "", "token=", "token=12345", "token=123456", "tokentoken: abcdef", "secret = 'passwd=abcdefg'", "API_KEY=abcdef apikey='abcdef' Api_key\n=abcdef", "PASSWORD\"  :  \"s3cr.et=", "password=password=password=abcdef",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAKIA" + "B" * 30, "xAKIA" + "0" * 40 + "x", "akia" + "A" * 30, "a" * 23, "a" * 24, "F" + "0123456789abcdef" * 3 + "G", "é" * 5 + "0" * 30 + "\U0001f600" + "f" * 30,
    "secret:" + "ab" * 20, "tоken=abcdefgh", "ſecret=abcdefgh", "toKen=abcdefgh", "token =abcdefgh", "token\t=abcdefgh", ("token=abcdef " + "0" * 24 + " ") * 2000,
]


def plain(text):
    spans = []
    for order, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        spans += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern.replace("(?i:", "(?ai:"), text or "") if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def held(got, texts):
    for g in got:
        want = plain(texts[g["doc_id"]])
        assert g["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[g["doc_id"]][:80]
        assert not want or set(want.split(",")) <= set(g["spans"].split(","))
        assert [g[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in want.split(",")) for k in PATTERNS]


def test_base_spans_of_odd_texts(spark):
    texts = dict(enumerate(ODD))
    got = secret_scan.secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    held(got, texts)


def test_base_spans_of_all_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    got = secret_scan.secrets(docs).collect()
    held(got, {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    counts = duckdb.sql(f"{SQL} FROM '{path}'").fetchall()
    assert sorted((g["doc_id"], g["n_assign"], g["n_access"], g["n_hex"]) for g in got) == sorted(counts)
    assert sum(g["n_assign"] + g["n_access"] + g["n_hex"] for g in got) > 0
