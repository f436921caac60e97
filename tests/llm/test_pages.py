"""Extraction on hand-written pages of many makers, on the given pages, and on odd rows and empty tables.

In pages/*.txt a page follows each line of #####; its main text's blocks hold a §, those that may count either way a ¤.
The generator of training pages was written with chosen_on.txt in view, held_out.txt was only measured.
"""

from pathlib import Path

import numpy as np
import pytest

from tideline.llm import html_extract

PAGES = "page_id long, url string, html string"


def labelled(name):
    out = []
    for part in (Path(__file__).parent / "pages" / f"{name}.txt").read_text().split("##### ")[1:]:
        found = html_extract.blocks(part.split("\n", 1)[1])
        kinds = ["main" if "§" in b.text else "either" if "¤" in b.text else "other" for b in found]
        out.append(([b._replace(text=b.text.replace("§", "").replace("¤", "")) for b in found], np.array(kinds)))
    return out


@pytest.mark.parametrize(("name", "precision", "recall"), [("chosen_on", 0.97, 0.97), ("held_out", 0.92, 0.92)])
def test_hand_written_pages(name, precision, recall):
    pages = labelled(name)
    kept = [p >= 0.5 for p in html_extract.probabilities(html_extract.trained(), [html_extract.vectors(b) for b, _ in pages])]
    assert len(pages) == 16 and all(k.any() for k in kept)
    k, kinds = np.concatenate(kept), np.concatenate([y for _, y in pages])
    right = (k & (kinds == "main")).sum()
    assert right / (k & (kinds != "either")).sum() >= precision
    assert right / (kinds == "main").sum() >= recall


def test_given_pages_keep_their_articles(spark):
    """All given pages hold one article element; its blocks are the main text but for one in 1,000."""
    wrong = blocks = 0
    htmls = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    found = [html_extract.blocks(h) for h in htmls]
    for some, p in zip(found, html_extract.probabilities(html_extract.trained(), [html_extract.vectors(b) for b in found]), strict=True):
        for b, q in zip(some, p, strict=True):
            place = b.place
            while place is not None and place.names[0] != "<article>":
                place = place.around
            blocks += 1
            wrong += (place is not None) != (q >= 0.5)
    assert wrong <= blocks / 1000


def test_machine_made_names_say_nothing():
    a, b = (html_extract.vectors(html_extract.blocks(f"<div class='{name}'><p>Some words here.</p></div>")) for name in ("css-q8z1", "sc-XkPw"))
    assert np.array_equal(a[:, : html_extract.PATH], b[:, : html_extract.PATH])
    c = html_extract.vectors(html_extract.blocks("<div class='x-sidebar__inner'><p>Some words here.</p></div>"))
    assert not np.array_equal(a[:, : html_extract.PATH], c[:, : html_extract.PATH])


def test_measures_of_what_is_around():
    found = html_extract.blocks("<div><p>12345</p><p>123<a>45</a></p></div>67890")
    held = html_extract._held(found)
    assert held[None] == [15, 2] and held[found[0].place.around] == [10, 2] and held[found[1].place] == [5, 2]


def test_deeply_nested_pages_are_measured_in_linear_time():
    found = html_extract.blocks("<div>x" * 20_000)
    held = html_extract._held(found)
    assert held[None][0] == 20_000 and min(h[0] for h in held.values()) == 1


def test_empty_table_and_clashing_columns(spark):
    empty = html_extract.extracted(spark.createDataFrame([], PAGES))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars"]
    page = "<body><article><h1>Title of it</h1><p>Some words stand here, and more.</p></article></body>"
    rows = [(1, "u", page, "t", 7, "b", 1), (1, "u", page, None, None, None, None), (2, None, None, "t", 7, "b", 1)]
    got = html_extract.extracted(spark.createDataFrame(rows, PAGES + ", text string, n_chars long, blocks string, place int")).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == [(1, "Title of it\nSome words stand here, and more.", 44)] * 2 + [(2, "", 0)]
