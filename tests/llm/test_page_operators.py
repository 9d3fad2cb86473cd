import base64
import collections
import hashlib
import html as entities
import re
import zlib

import numpy as np
import pytest

from recollect.llm import extraction, warc
from recollect.llm.dom import Tree

from .fixtures import pages, prose

PAGES = [(1, "http://www.B.example.com/x?q=1#f", "<p>same</p>"), (2, "https://b.example.com/x?q=1", "<p>same</p>"), (3, None, None), (4, "http://a.example.org:8080/", ""),
         (5, "not a url\r\nX: 1", "<p>é ü</p>"), (6, "http://b.example.com/x?q=1", "<p>same</p>"), (6, "http://b.example.com/x?q=1", "<p>same</p>"),
         (7, "http://c.example.com/long", "<p>" + "long text " * 30000 + "</p>"), (None, "http://n.example.com/", "<p>other</p>"), (8, "http://c.example.com/long", "\r\n\r\nWARC/1.1")]


def brute_records(rows, least):
    last = collections.defaultdict(set)
    for i, _, h in rows:
        last[h or ""].add(i)
    out = []
    for i, _, h in rows:
        data, top = (h or "").encode(), max((x for x in last[h or ""] if x is not None), default=None)
        copies = sum((x[2] or "") == (h or "") for x in rows) > 1 and len(data) >= least
        refers = top if copies and i != top else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,lines", [(0, 512), (5, 1)])
def test_archives_round_trip(spark, least, lines):
    df = pages(spark, PAGES)
    archives = warc.write(df, least=least, lines=lines)
    got = warc.lookup(archives, df)
    assert sorted(map(tuple, warc.digest(got).collect()), key=repr) == brute_records(PAGES, least)
    payloads = {(r["page_id"]): r["payload"] for r in got.where("record_type = 'response'").collect()}
    assert bytes(payloads[7]) == PAGES[7][2].encode() and bytes(payloads[8]) == PAGES[9][2].encode() and bytes(payloads[5]) == "<p>é ü</p>".encode()
    one = warc.lookup(archives, df.where("page_id = 2")).collect()
    assert [r["page_id"] for r in one] == [2] and warc.lookup(archives, df.where("page_id = 2").withColumn("page_id", df.page_id + 100)).collect() == []


def test_archives_are_gzip_members_and_empty_tables_work(spark, tmp_path):
    archives = warc.write(pages(spark, PAGES[:3]).coalesce(1), root=str(tmp_path / "w"))
    data = next((tmp_path / "w" / "archives").iterdir()).read_bytes()
    assert zlib.decompress(data, 31).startswith(b"WARC/1.1\r\nWARC-Type: ") and len(archives.files) >= 1
    none = pages(spark, PAGES[:1]).where("false")
    assert warc.lookup(warc.write(none), none).collect() == [] and warc.lookup(archives, none).collect() == []


def test_keys_reverse_hosts():
    assert warc.url_key("http://www.a.Example.com:80/x?y#z") == "com,example,a)/x?y" and warc.url_key("https://b.org:8443") == "org,b:8443)/" and warc.url_key(None) == ")/"


def test_damaged_payload_is_an_error():
    record = warc.record(1, "u", b"payload", None)
    assert warc.parse(record)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"payload\r\n\r\n", b"damaged\r\n\r\n"))


PAGE = ("<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script><style>p{}</style></head><body><nav><ul><li><a href=x>Menu one</a></li><li><a href=y>Menu two</a></li></ul></nav>"
        "<div class='ad'>Buy this now.</div><article><h1>{h}</h1><p><b>{a}<br><p>{b}</p><ul><li>{c}</ul><div class=\"comments\">Great post.</div></article><aside>Related</aside>"
        "<form><label>Mail</label><input></form><footer>&copy; Site</footer></body></html>")


def page(i):
    parts = [prose(10 * i + k, n) for k, n in enumerate((6, 50, 40, 12))]
    return PAGE.replace("{h}", parts[0]).replace("{a}", parts[1] + " &amp; &#233;").replace("{b}", "\n  ".join(parts[2].split(" ", 1))).replace("{c}", parts[3]), \
        "\n".join([parts[0], parts[1] + " & é", parts[2], parts[3]])


def test_article_text_is_found_and_the_rest_left_out(spark):
    rows = [(i, f"http://h{i}.example.com/", page(i)[0]) for i in range(60)]
    odd = [(100, "u", None), (101, "u", ""), (102, None, "<p>unclosed <b>bold <i>both"), (103, "u", "<" * 2000), (104, "u", "<div>" * 3000 + "deep"), (105, "u", "<script>never ends"), (0, "u", rows[0][2])]
    df = pages(spark, rows + odd)
    model = extraction.train(df)
    got = extraction.digest(extraction.extract(df, model)).collect()
    for r, (i, u, _) in zip(got, rows + odd):
        assert (r["page_id"], r["url"], r["n_chars"]) == (i, u, len(r["text"]))
        if i < 60:
            assert r["text"] == page(i)[1]
    text = {r["page_id"]: r["text"] for r in got}
    assert text[100] == text[101] == text[105] == ""
    assert extraction.extract(df.where("false"), model).collect() == []
    untrained = extraction.train(df.where("false"))
    assert {r["page_id"]: r["text"] for r in extraction.extract(df, untrained).collect()}[102] == "unclosed bold both"


def test_only_scripts_and_styles_are_left_out():
    every = lambda html: (lambda t: t.text([True] * len(t.tags)))(Tree(html))
    assert every('<article><svg class="i"/><p>one</p><math/><p>two</p></article>') == "one\ntwo"
    assert every("<article><p>a <math><mi>x</mi></math> b</p><svg><path d='M0'/><text>label</text></svg><p>c</p></article>") == "a x b\nlabel\nc"
    assert every("<article><object data=x><p>fallback</p></object><noscript><p>still</p></noscript><p>on</p>") == "fallback\nstill\non"
    assert every("<template><p>t</p></template><iframe src=x>f</iframe><p>p</p><svg>open<p>end</p>") == "t\nf\np\nopen\nend"
    assert every("<p>a</p><script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>c</p> --><p>d</p>") == "a\nd"


def test_given_pages_match_their_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in extraction.extract(df, extraction.train(df)).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner))
        assert texts[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(1)
    tree = Tree("<div>aa<p>bb<i>cc</i></p><p>dd</p></div><ul>ee</ul>")
    n = len(tree.tags)
    for _ in range(200):
        rating = rng.normal(size=n)
        chosen = extraction.decode(tree, rating)
        weight = np.full(n, 0.05)
        for node, run, _ in tree.runs:
            weight[node] += len(run.strip())
        score = lambda inside: sum((1 if x else -1) * r * w for x, r, w in zip(inside, rating, weight))
        best = -np.inf
        for states in np.ndindex(*(3,) * n):
            fine = states[0] < 2 and all(states[i] in {0: (0, 1), 1: (1, 2), 2: (2,)}[states[tree.parents[i]]] for i in range(1, n))
            if fine:
                best = max(best, score([s == 1 for s in states]))
        assert abs(score(chosen) - best) < 1e-9


def test_boosting_separates_what_thresholds_can():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > -0.1)).astype(float)
    model = extraction.boost(x, y)
    assert ((model.rate(x) > 0) == (y > 0)).mean() > 0.95
