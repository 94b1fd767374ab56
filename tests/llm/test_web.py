import base64
import hashlib
import io
import random

import pytest

from riskloom.llm import html_text as H
from riskloom.llm import warc as W

SCHEMA = "page_id long, url string, html string, sha string, id int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA).repartition(3)


def sample():
    rnd = random.Random(2)
    rows = [(i, f"https://www.site{i % 5}.org/Path/{i % 7}?b=2&a={i % 3}#x", f"<p>text {rnd.randrange(20)}</p>é") for i in range(80)]
    return rows + [(100, None, None), (101, "", ""), (102, "no url", ""), (103, "http://[bad", "x" * 300_000), (104, "http://h\r\nWARC-Type: x", "\r\n\r\nWARC/1.1\r\n")]


def brute(rows, least=0):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", i), i)
    out = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= least and best[h or ""] != i
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", best[h or ""] if revisit else None)
    return out


def test_round_trip(spark):
    rows = sample()
    for least in (0, 5, 10**6):
        got = W.capture_histories(pages(spark, rows), least).collect()
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(rows, least)
        keys = [(r.url_key, r.captured, r.page_id) for r in got]
        assert keys == sorted(keys)


def test_many_runs_are_merged_in_passes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 400)
    monkeypatch.setattr(W, "GROUP_ROWS", 2)
    rows = sample()
    archives = W.write_archives(pages(spark, rows), str(tmp_path / "a"))
    runs = W.read_runs(archives, str(tmp_path / "r"))
    assert runs.count() > 20
    got = W.merge_runs(spark, runs, str(tmp_path), fan_in=3, range_rows=10).collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == len(rows)
    row = next(r for r in got if r.page_id == 103)
    with open(row.archive, "rb") as f:
        f.seek(row.offset)
        record = W.parse(next(W.members(f))[1])
    assert record["id"] == 103 and record["bytes"] == 300_000


def test_repeated_rows_and_empty(spark):
    rows = [(1, "http://a.b/", "x"), (1, "http://a.b/", "x"), (None, "http://a.b/", "y")]
    got = W.capture_histories(pages(spark, rows)).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(1, "response"), (1, "response"), (None, "response")] or len(got) == 3
    assert {r.record_type for r in got} == {"response"}
    assert W.capture_histories(pages(spark, [])).collect() == []


def test_a_changed_payload_is_noticed():
    record = W.record(1, "http://a/", 0, b"payload")
    content = next(W.members(io.BytesIO(record)))[1]
    assert W.parse(content)["bytes"] == 7
    with pytest.raises(ValueError):
        W.parse(content.replace(b"payload", b"pAyload"))


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(9):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(12))) for _ in range(k)]
        got = list(W.merged([iter([(x, x) for x in r]) for r in runs])) if runs else []
        assert got == sorted(x for r in runs for x in r)


def test_url_keys():
    assert W.url_key("HTTPS://www.A.org:443/X?b=2&a=1#f") == "org,a)/x?a=1&b=2"
    assert W.url_key("http://a.org:8080") == "org,a:8080)/"
    assert W.url_key(None) == ""


LONG = "The reader of this text is told that it is one of the good ones, for it has all the words that a text of this kind has, and it is long."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="top"><p>{LONG}</p></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice"><p>{LONG}</p></div>
<article><header><h1>Title &amp; more</h1></header><!-- c --><p>{LONG}<br>next&nbsp;line <b>bold</b><i>er</i><p>Short.
<div class="advert"><p>{LONG}</p></div><table><tr><td>cell<td>two</table><aside><p>{LONG}</p></aside>
<form><p>{LONG}</p></form><ul><li><a href="/x">A link of links</a></li></ul><p>End.</article>
<section id="comments"><article><p>{LONG}</p></article></section><div class="sidebar"><p>{LONG}</p></div><footer><p>{LONG}</p></footer>"""


def test_article_alone_stays():
    assert H.main_text(PAGE) == f"Title & more {LONG} next line bolder Short. cell two End."


def test_pages_without_article():
    text = f"<body><div><a href=1>one</a> | <a href=2>two</a></div><div id=content><p>{LONG} {LONG}</p><p>Short one.</p><p>{LONG} {LONG}</p></div><div class=footer>{LONG}</div>"
    assert H.main_text(text) == f"{LONG} {LONG} Short one. {LONG} {LONG}"


def test_short_blocks_take_the_nearest_label():
    found = [("x", 0, 1, False)] * 6
    keep = H.second_pass(found, [H.GOOD, H.OPEN, H.OPEN, H.OPEN, H.OPEN, H.BAD])
    assert keep == [True, True, True, False, False, False]
    assert H.second_pass(found[:3], [H.GOOD, H.OPEN, H.BAD]) == [True, True, False]
    assert H.second_pass(found[:2], [H.OPEN, H.PLACE]) == [True, False]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p"), (5, "u", "a < b > c"), (6, "u", "<article>x<script>never closed"), (7, "u", "<article>" + "<div>" * 3000 + "deep"), (8, "u", "<article><p class='a>b\">x</p>"), (9, "u", "<article>&#x41;&lt;p&gt;&bogus;</article>"), (10, "u", PAGE), (10, "u", PAGE)]
    got = H.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[6] == "x" and by[7] == "deep" and by[9] == "A<p>&bogus;"
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract(pages(spark, [])).collect() == []


def test_a_long_page_takes_linear_time():
    text = "<article>" + "<p>word of the day</p><a href='x\">" * 20_000
    assert H.main_text(text) is not None


def test_marks_of_places():
    """Containers of the whole page, compounds, other languages, links around blocks, drawings: none loses the article."""
    for tag in ("class='content has-sidebar'", "class='layout no-sidebar'", "id='related-work'", "class='modal'"):
        assert H.main_text(f"<body><div {tag}><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG} {LONG}", tag
    assert H.main_text(f"<body><div class='cookie-notice'><p>{LONG}</p></div><p>{LONG} End.</p><p>{LONG}</p><p>{LONG}</p></body>") == f"{LONG} End. {LONG} {LONG}"
    russian = "Это длинный абзац русского текста, в котором достаточно слов и знаков, чтобы считать его содержанием страницы, а не меню."
    japanese = "これは長い日本語の段落であり、ページの本文として扱われるべき十分な長さを持っています。" * 3
    for text in (russian, japanese):
        assert H.main_text(f"<body><ul><li><a href='/'>Home</a></li></ul><p>{text}</p><p>{text}</p></body>") == f"{text} {text}"
    assert H.main_text("<p>Hello world</p>") == "Hello world"
    assert H.main_text(f"<body><p>{LONG}</p><a href='/x'><div>{LONG} Card.</div></a></body>") == LONG
    assert H.main_text(f"<body><article><svg viewBox='0 0 1 1'/><p>{LONG}</p><svg><path d='x'/></svg><p>{LONG}</p></article></body>") == f"{LONG} {LONG}"
    assert H.main_text(f"<body><article><svg><p>{LONG}</p></article></body>") == LONG


def test_second_pass_against_brute_force():
    """Each undecided block looks outward for the nearest decided ones of its region."""
    rnd = random.Random(9)
    for _ in range(400):
        n = rnd.randrange(1, 14)
        found = [("x", 0, rnd.randrange(3), "") for _ in range(n)]
        labels = [rnd.choice([H.GOOD, H.BAD, H.OPEN, H.OPEN, H.PLACE]) for _ in range(n)]
        want = []
        for k, label in enumerate(labels):
            row = [j for j in range(n) if found[j][2] == found[k][2] and labels[j] != H.PLACE]
            if not {H.GOOD, H.BAD} & set(labels):
                want.append(label == H.OPEN)
            elif label != H.OPEN:
                want.append(label == H.GOOD)
            else:
                far = [(abs(row.index(j) - row.index(k)), labels[j]) for j in row if labels[j] in (H.GOOD, H.BAD)]
                nearest = [x for d, x in far if d == min(far)[0]]
                want.append(H.GOOD in nearest if nearest else bool(found[k][2]))
        assert H.second_pass(found, labels) == want


def test_first_pass_against_its_rules():
    """The label of each block follows from place, length, links and stop words, one rule after the other."""
    rnd = random.Random(10)
    good, dull = LONG, "Lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua"
    for _ in range(400):
        found = [(t, rnd.choice([0, 0, len(t)]), rnd.randrange(2), rnd.choice(["", "", "", "weak", "bad"])) for t in rnd.choices([good, dull, "short"], k=rnd.randrange(1, 9))]
        long = [b for b in found if len(b[0]) >= H.LONG and b[3] != "bad"]
        known = sum(H.stop_density(b[0]) * len(b[0]) for b in long) >= H.KNOWN * sum(len(b[0]) for b in long)
        article = any(b[2] and b[3] != "bad" for b in found)
        for (text, linked, region, place), label in zip(found, H.first_pass(found), strict=True):
            if place == "bad" or (article and not region):
                want = H.PLACE
            elif linked:
                want = H.PLACE if region or place else H.BAD
            elif text == "short":
                want = H.PLACE if place else H.OPEN
            elif text == good or not known:
                want = H.GOOD
            else:
                want = H.OPEN if region else H.BAD
            assert label == want
