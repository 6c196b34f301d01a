import random

import pytest

from brindle.llm.boilerplate import furniture_lines, main_text

SCHEMA = "chunk_id string, source string, ordinal int, text string, metadata map<string,string>, host string, path string"


def rows_of(n_pages):
    """Pages of two hosts whose furniture is known, as one text (even pages) or as elements (odd pages)."""
    r = random.Random(4)
    rows, bad = [], set()
    noun = lambda: r.choice("cache shard ledger parser index window mirror policy".split())
    for n in range(n_pages):
        host = ("docs.bluemill7.example", "www.redfern2.example", "solo.tinypond.example")[0 if n % 3 else 1 if n else 2]
        site, url = {"d": "BlueMill", "w": "RedFern", "s": "TinyPond"}[host[0]], f"https://{host}/a/{n}"
        menu = {"d": "Home | Prices | Help | Login", "w": "Start / Shop / Blog / Contact", "s": "Home | Prices | Help | Login"}[host[0]]
        title = f"How to move the {noun()} number {n}"
        body = [f"Set the {noun()} to {n} and the {noun()} will not be lost until the {noun()} is read again." for _ in range(3)]
        lines = [(f"{title} – {site}", "title", 1), (menu, "paragraph", 0), (f"Posted by {noun()}-{noun()} on {n % 28} May", "paragraph", 0), (title, "heading", 1), (body[0], "paragraph", 1), ("Steps" if n % 18 == 2 else f"Read the {noun()} of {n} before the {noun()} and the {noun()}.", "paragraph", 1), (f"Share this page with {site}", "paragraph", 0)]
        lines += [(b, "paragraph", 1) for b in body[1:]] + [("Read next", "heading", 0), (f"Why we read the {noun()} late in {n}", "link", 0), (" ".join(body[1].split()[2:5]), "link", 1), (f"© 2024 {site}. All rights reserved.", "paragraph", 0)]
        if n % 2:
            for k, (text, kind, main) in enumerate(lines):
                rows.append((f"c{n}_{k}", url, k, text, {"parser": "html", "type": kind, **({"level": "1"} if kind == "heading" else {}), **({"href": "/x"} if kind == "link" else {})}, "x", "y"))
                if not main:
                    bad.add((f"c{n}_{k}", 0))
        else:
            lines = [x for x in lines if not (x[1] == "link" and x[2])]
            rows.append((f"c{n}", url, 0, "\n\n".join(x[0] for x in lines), {"parser": "html", "type": "page"}, "x", "y"))
            bad |= {(f"c{n}", 2 * k) for k, x in enumerate(lines) if not x[2]}
    return rows, bad


@pytest.fixture(scope="module")
def pages():
    return rows_of(90)


def test_furniture_is_found(spark, pages):
    rows, bad = pages
    df = spark.createDataFrame([*rows, *rows[:40], ("n", "https://a.example/", 0, None, {"parser": "html"}, "", ""), ("e", None, 0, " \n ", {"parser": "html"}, "", ""), ("p", "f.pdf", 0, "Home | a | b | c", {"parser": "pdf"}, "", ""), ("m", "x", None, "Home | a | b | c", None, "", "")], SCHEMA)
    out = [tuple(r) for r in furniture_lines(df).collect()]
    assert len(out) == len(set(out))
    assert len(set(out) ^ bad) <= 0.02 * len(bad), sorted(set(out) ^ bad)[:10]


def test_main_text(spark, pages):
    rows, bad = pages
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.chunk_id: r.text for r in main_text(df).collect()}
    page = next(r for r in rows if r[0] == "c2")
    assert out["c2"].split("\n")[0] == page[3].split("\n\n")[0] and "Home |" not in out["c2"] and "Steps" in out["c2"]


def test_empty_and_null_source(spark):
    df = spark.createDataFrame([("a", None, None, "Some sentence that says a little.", {"parser": "html"}, "", "")], SCHEMA)
    assert furniture_lines(df).count() == 0
    assert furniture_lines(df.limit(0)).count() == 0
    assert main_text(df.limit(0)).count() == 0


def test_a_long_page_is_one_page(spark, pages, monkeypatch):
    rows, _ = pages
    url = "https://long.example/a"
    kinds = {0: ("The long page - Example", "title"), 1: ("Home | Prices | Help | Login", "paragraph"), 5001: ("Home > The long page", "paragraph"), 5002: ("moved the shard", "link"), 5003: ("nowhere named", "link")}
    long = [(f"l{k}", url, k, *kinds.get(k, (f"Line {k} tells how we moved the shard.", "paragraph"))) for k in range(5004)]
    rows = [*rows, *[(a, b, k, text, {"parser": "html", "type": kind}, "", "") for a, b, k, text, kind in long], *rows[:20]]
    df = spark.createDataFrame(rows, SCHEMA)
    out = [tuple(r) for r in furniture_lines(df).collect()]
    assert {x for x in out if x[0] in ("l5001", "l5002", "l5003")} == {("l5001", 0), ("l5003", 0)} and len(out) == len(set(out))
    for most in (0, 8, 10**6):
        monkeypatch.setattr("brindle.llm.boilerplate.LONG", most)
        assert sorted(tuple(r) for r in furniture_lines(df).collect()) == sorted(out)
