"""Each operator against a brute-force version or a planted truth, and on odd rows and empty tables."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest

from tideline.llm import ann, decontaminate, html_extract, jaccard_join, line_dedup, piece_codec, quality, secret_scan, substring_dedup, toxicity
from tideline.llm.queries import QUERIES

DOCS = "doc_id long, text string"
# Names that operators use inside, as extra columns of the input.
CLASHING = ["key", "class", "band", "lines", "first", "id", "places", "score", "count", "values", "y", "slots", "hash"]
WORDS = [f"{a}{b}{c}" for a in "bdgkmt" for b in "aeiou" for c in "lnrs"]


def prose(r, n):
    return " ".join(r.choice(WORDS, n))


def changed(r, text, n):
    words = text.split(" ")
    for i in r.integers(0, len(words), n):
        words[i] = str(r.choice(WORDS))
    return " ".join(words)


def labels_of(rows):
    return [(i, int(i % 2), int(i % 3 == 0)) for i, _ in rows if i is not None]


def odd_rows():
    r = np.random.default_rng(1)
    return [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \t\r\n\n"), (None, prose(r, 40)), (5, prose(r, 20_000)), (6, "é " * 50 + "\U0001f600")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 7)], "doc_id long, quality int, toxic int")


def document_operators(spark, labels):
    benchmark = spark.createDataFrame([(1, "what is the colour of the sky . it is blue"), (2, None), (None, "x")], "item_id long, text string")
    return {
        "op1": lambda d: quality.quality(d, labels),
        "op2": line_dedup.line_dedup,
        "op4": secret_scan.secrets,
        "op5": lambda d: toxicity.toxicity(d, labels),
        "op6": substring_dedup.substring_dedup,
        "op7": piece_codec.encoded,
        "op8": jaccard_join.jaccard_join,
        "op10": lambda d: decontaminate.contamination(d, benchmark),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op10"])
def test_odd_rows_and_empty_tables(spark, labels, name):
    run = document_operators(spark, labels)[name]
    rows = odd_rows()
    docs = spark.createDataFrame([(*x, *["z"] * len(CLASHING)) for x in rows], DOCS + "".join(f", `{c}` string" for c in CLASHING))
    got = run(docs).collect()
    if name == "op10":
        assert got == []
    else:
        assert sorted(str(g["doc_id"]) for g in got) == sorted(str(i) for i, _ in rows)
    assert run(docs.limit(0)).count() == 0


def test_quality_tells_held_out_rows_apart(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(r.choice(WORDS[:60] if i % 2 else WORDS[50:], 60))) for i in range(400)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.quality(spark.createDataFrame(rows, DOCS), marks).filter("held_out").collect()
    assert len(got) > 80 and np.mean([g["predicted"] == g["doc_id"] % 2 for g in got]) >= 0.95
    assert all(0 <= g["score"] <= 1 for g in got)


def test_toxicity_finds_held_out_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, prose(r, 30) + (" vilest scum" if i % 4 == 0 else "") + " " + prose(r, 30)) for i in range(600)]
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), marks).filter("held_out").collect()
    assert np.mean([g["toxic"] == (g["doc_id"] % 4 == 0) for g in got]) >= 0.95


def test_toxicity_finds_rare_forms_of_a_stem(spark):
    r = np.random.default_rng(11)
    # Toxic rows have two of 200 endings of a stem each, so most forms of the held-out rows are new.
    stem = [f"vilesx{a}{b}" for a in WORDS[:20] for b in WORDS[20:30]]
    rows = [(i, prose(r, 30) + (" " + " x ".join(r.choice(stem, 2)) if i % 8 == 0 else "") + " " + prose(r, 30)) for i in range(800)]
    marks = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), marks).filter("held_out").collect()
    toxic = [g for g in got if g["doc_id"] % 8 == 0]
    assert len(toxic) > 20 and np.mean([g["toxic"] for g in toxic]) >= 0.9
    assert np.mean([g["toxic"] for g in got if g["doc_id"] % 8]) <= 0.05


def test_line_dedup_against_brute_force(spark):
    r = np.random.default_rng(4)
    base = [prose(r, int(r.integers(3, 30))) for _ in range(25)]
    rows = [(i, "\n".join(changed(r, str(r.choice(base)), int(r.integers(0, 4))) for _ in range(int(r.integers(1, 6))))) for i in range(60)]
    lines = [(i, k, line, frozenset(line.split())) for i, text in rows for k, line in enumerate(text.split("\n"))]
    kept = {i: [] for i, _ in rows}
    for at, (i, _, line, own) in enumerate(lines):
        if not any(10 * len(own & x[3]) >= 8 * len(own | x[3]) for x in lines[:at]):
            kept[i].append(line)
    got = {g["doc_id"]: g["text"] for g in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: "\n".join(x) for i, x in kept.items()}


def test_substring_dedup_against_brute_force(spark):
    r = np.random.default_rng(5)
    shared = [prose(r, 60) for _ in range(4)]
    rows = [(i, prose(r, int(r.integers(0, 60))) + " " + str(r.choice(shared)) + "\t" + prose(r, 20)) for i in range(30)] + [(99, prose(r, 40)), (99, prose(r, 34))]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in rows]
    seen = {}
    for k, w in enumerate(words):
        for p in range(len(w) - 34):
            seen.setdefault(tuple(w[p : p + 35]), []).append((k, p))
    gone = {(k, p + d) for x in seen.values() if len(x) > 1 for k, p in x for d in range(35)}
    want = sorted((i, len(w), sum((k, p) in gone for p in range(len(w))), hashlib.sha256(" ".join(x for p, x in enumerate(w) if (k, p) not in gone).encode()).hexdigest()) for k, ((i, _), w) in enumerate(zip(rows, words, strict=True)))
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((g["doc_id"], g["n_words"], g["n_removed"], g["kept_sha256"]) for g in got) == want


def test_jaccard_join_against_brute_force(spark):
    r = np.random.default_rng(6)
    base = [prose(r, 80) for _ in range(6)]
    rows = [(i, changed(r, base[i % 6], int(r.integers(0, 4)))) for i in range(60)] + [(100, base[0]), (101, base[0]), (102, "one two")]
    sets = {i: {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    links = {(a, b) for a, b in itertools.permutations(sets, 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    group = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            group[a] = min(group[a], group[b])
    docs = spark.createDataFrame(rows, DOCS)
    got = {g["doc_id"]: g for g in jaccard_join.jaccard_join(docs).collect()}
    assert {i: g["n_links"] for i, g in got.items()} == {i: sum(a == i for a, _ in links) for i in sets}
    assert {i: g["group_id"] for i, g in got.items()} == group
    assert got[101]["class_id"] == got[100]["class_id"]
    assert {x["doc_id"] for x in jaccard_join.one_of_each_group(docs).collect()} == set(group.values())


def test_secret_scan_base_spans(spark):
    key = "AKIA" + "Q7" * 8
    text = f'\U0001f600 Password: "hunter22" api-key=abcdef api_key = \'abc.def/1\' {key} {"0a1b" * 6} token=abc'
    got = secret_scan.secrets(spark.createDataFrame([(1, text)], DOCS)).first()
    spans = [("assign", *re.search(r'Password: "hunter22', text).span()), ("assign", *re.search(r"api_key = 'abc.def/1", text).span()), ("access", *re.search(key, text).span()), ("hex", *re.search("(0a1b)+", text).span())]
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: s[1]))
    assert (got["n_assign"], got["n_access"], got["n_hex"]) == (2, 1, 1)
    assert got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_html_extraction(spark):
    body = "".join(f"<p>Sentence {w} of the  main\ntext &amp; more.</p>" for w in ("one", "two", "three"))
    page = f"<html><head><title>t</title><style>x</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><article><h1>A headline here.</h1>{body}</article><footer><p>Copyright notice.</p></footer><script>var a;</script></body></html>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "<", "x"), (None, "u", "plain &lt;words", "x")]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    first = next(g for g in got if g["page_id"] == 1)
    assert first["text"] == "A headline here.\n" + "\n".join(f"Sentence {w} of the main text & more." for w in ("one", "two", "three"))
    assert len(got) == 5 and all(g["n_chars"] == len(g["text"]) for g in got)
    assert next(g for g in got if g["page_id"] == 2)["text"] == ""


def test_secret_scan_finds_random_strings_and_counts_copies_once(spark):
    r = np.random.default_rng(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(r.choice(list(letters), 32)) for _ in range(60)]
    rows = [(i, f"see {t} here") for i, t in enumerate(tokens)]
    copied = "get_user_account_value_list_index"
    rows += [(1000 + i, f"call {copied} now") for i in range(3000)]
    got = {x["doc_id"]: x["spans"] for x in secret_scan.secrets(spark.createDataFrame(rows, DOCS)).collect()}
    found = [i for i in range(60) if got[i] == "random:4:36"]
    assert len(found) >= 54
    assert not any(got[1000 + i] for i in range(3000))


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><meta charset=utf-8><title>no</title><body><article><p>Hello there.</article>", ["Hello there."]),
        ("<html><head><title>no</title>Hello", ["Hello"]),
        ('<p class="a>Hello</p><p>there', ["Hello", "there"]),
        ('<div title="a>b">in</div>', ["in"]),
        ("<p>Formula <math><mi>x</mi></math> end <script>no()</script>here", ["Formula x end here"]),
        ("<p>1 < 2 &amp; <b>so\n on</b><!-- no -->", ["1 < 2 & so on"]),
        ("<select><option>no</select><textarea>no</textarea>yes", ["yes"]),
        ("", []),
    ],
)
def test_html_blocks(page, texts):
    assert [b.text for b in html_extract.blocks(page)] == texts


def test_html_blocks_of_broken_pages_in_linear_time():
    began = time.time()
    for page, n in (('<p class="a>x ' * 40_000, None), ("<div>x" * 100_000, 100_000), ("<b>x" * 100_000 + "</i>" * 1000 + "<p>y" * 1000, 1001), ("<" * 500_000, 1)):
        found = html_extract.blocks(page)
        assert n is None or len(found) == n
        html_extract.vectors(found[:2000])
    assert time.time() - began < 60


def test_html_every_word_of_a_block_counts():
    words = [f"w{i}" for i in range(200)]
    a, b = (html_extract.vectors(html_extract.blocks(f"<p>{' '.join(w)}</p>")) for w in (words, [*words[:100], *["advert"] * 100]))
    assert not np.array_equal(a, b)


def test_html_extraction_on_pages_of_a_held_out_generator():
    pages = html_extract.generated(200, seed=99)
    found = html_extract.probabilities(html_extract.trained(), [x for x, _ in pages])
    p, y = np.concatenate(found) >= 0.5, np.concatenate([y for _, y in pages]) > 0
    assert (p & y).sum() / p.sum() > 0.95 and (p & y).sum() / y.sum() > 0.95


def test_nbest_against_enumeration_and_round_trip(spark):
    pieces = piece_codec.load()
    part = " scaling"

    def all_of(text):
        if not text:
            return [(0.0, ())]
        return [(pieces.scores[pieces.known[text[:n]]] + s, (pieces.known[text[:n]], *ids)) for n in range(1, len(text) + 1) if pieces.known.get(text[:n], -1) >= 0 for s, ids in all_of(text[n:])]

    want = sorted((-s for s, _ in all_of(part)))[:5]
    assert np.allclose([-s for s, _ in piece_codec.segmentations(pieces, part, 5)], want)
    rows = [(1, "Tab\tnew\nline  two spaces é \U0001f600 "), (2, ""), (3, None)]
    got = {g["doc_id"]: g for g in piece_codec.with_text(piece_codec.encoded(spark.createDataFrame(rows, DOCS))).collect()}
    assert all(g["round_trip"] for g in got.values())
    assert [got[i]["decoded_text"] for i in (1, 2, 3)] == [rows[0][1], "", ""]


def test_nearest_neighbours_recall_and_odd_vectors(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(30, 32))
    v = (centres[r.integers(0, 30, 2000)] + 0.5 * r.normal(size=(2000, 32))).astype(np.float32)
    bad = [(2000, None, "x"), (2001, [0.0] * 32, "x"), (2002, [float("nan")] * 32, "x"), (2003, [None] * 32, "x"), (None, [1.0] * 32, "x")]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + bad
    schema = "vec_id long, embedding array<float>, bucket string"
    got = ann.nearest(spark.createDataFrame(rows, schema)).collect()
    found = hit = 0
    for q in range(0, 2000, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(2000), d)) if i != q][:10]
        own = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 11))
        assert np.allclose([g["score"] for g in own], d[[g["vec_id"] for g in own]], rtol=1e-12)
        found, hit = found + 10, hit + len(set(best) & {g["vec_id"] for g in own})
    assert hit / found >= 0.9 and len(got) == 200
    assert ann.nearest(spark.createDataFrame(rows[:3], schema)).count() == 2
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("away", [0.0, 1e3, 1e6])
def test_nearest_neighbours_far_from_the_origin(spark, away):
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 16)) * 0.1 + away + 1.0
    x[300] = x[100]
    x[301] = x[100]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    exact = {}
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(600), d)).tolist() if i != q][:10]
        exact[q] = [(i, d[i]) for i in order]
    hit = sum((g["vec_id"], g["score"]) in exact[g["query_id"]] for g in got)
    assert hit >= 0.9 * 60 and (away == 0 or hit == 60)
    # Ties go to the smaller id.
    assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 100][:2] == [300, 301]


def test_decontamination_finds_planted_items_only(spark):
    r = np.random.default_rng(8)
    items = [(i, prose(r, 25) + " . " + prose(r, 6)) for i in range(20)]
    rows = [(i, prose(r, 100)) for i in range(40)]
    rows += [(100 + i, f"{prose(r, 30)} {items[i][1].upper()} {prose(r, 30)}") for i in range(10)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS)
    got = {(g["doc_id"], g["item_id"]) for g in decontaminate.contamination(docs, benchmark).collect()}
    assert got == {(100 + i, i) for i in range(10)}
    assert {x["doc_id"] for x in decontaminate.decontaminated(docs, benchmark).collect()} == set(range(40))
    assert decontaminate.contamination(docs, benchmark.limit(0)).count() == 0


def test_decontamination_finds_short_items_among_foreign_words(spark):
    r = np.random.default_rng(9)
    items = [(n, prose(r, n)) for n in range(3, 13)]

    def foreign(n):
        return " ".join(f"q{x}" for x in r.integers(0, 10**6, n))

    # Exact copies, and for items of 4 words or more copies without one word, at all offsets from a passage.
    rows = [(100 * n + k, f"{foreign(20 + k)} {text} {foreign(30)}") for n, text in items for k in range(8)]
    rows += [(100 * n + 50 + k, f"{foreign(20 + k)} {text.rsplit(' ', 1)[0]} {foreign(30)}") for n, text in items if n > 3 for k in range(8)]
    got = decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(g["doc_id"], g["item_id"]) for g in got} == {(i, i // 100) for i, _ in rows}


def test_decontamination_against_brute_force(spark):
    r = np.random.default_rng(10)
    items = [(i, prose(r, int(n)) + " . " + prose(r, 3)) for i, n in enumerate(r.integers(3, 45, 60))]
    rows = []
    for i, text in items:
        for share in (0, 0.1, 0.2, 0.3):
            words = [str(r.choice(WORDS)) if r.random() < share else w for w in text.split(" ")]
            spread = [x for w in words for x in ([w, "zz"] if r.random() < share else [w])]
            rows.append((len(rows), f"{prose(r, int(r.integers(0, 40)))} {' '.join(spread)} {prose(r, int(r.integers(0, 40)))}"))
    known = decontaminate.read_items(items)
    place = {h: k + 1 for k, h in enumerate(known.vocabulary.tolist())}
    want = {}
    for i, text in rows:
        own = decontaminate.read_items([(0, text)])
        order = own.items[0].words
        words = np.array([place.get(own.vocabulary[w - 1].item(), 0) for w in order])
        for item in known.items:
            n, answer = len(item.words), item.words[item.answer :]
            for start in range(0, len(words), decontaminate.STRIDE):
                near = words[max(0, start - n) : start + decontaminate.PASSAGE + n]
                found = decontaminate.common(item.words, near) / n, decontaminate.common(answer, near) / len(answer)
                if decontaminate.leaks(*found):
                    want[i, item.item_id] = max(found, want.get((i, item.item_id), found))
    got = decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 150 and {(g["doc_id"], g["item_id"]) for g in got} == set(want)
    assert all(g["lcs"] >= want[g["doc_id"], g["item_id"]][0] for g in got)


def test_pipeline_keeps_the_columns_of_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert corpus_pipeline.run(spark, folder).filter("round_trip").count() > 0


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
