"""Long texts, markup without end, ids that repeat with other texts, items without ids, and a plain form of the language model."""

import random
import time

import numpy as np
import pytest

from recollect.llm import decontaminate, language, neardup, secret_scan
from recollect.llm.dom import Tree

from .fixtures import documents, prose
from .test_text_operators import brute_near

CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_secrets_of_very_long_texts(spark):
    r = random.Random(1)
    hexes = [("".join(r.choice("0123456789abcdef") for _ in range(24))) for _ in range(5000)]
    long = "x9" + "".join(r.choice(CHARS) for _ in range(200_000))
    rows = [(1, "a-" * 200_000 + "b"), (2, long), (3, "é " + " ".join(hexes)), (4, "x" * 300_000), (5, "1" * 300_000)]
    found = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in secret_scan.find(documents(spark, rows)).collect()}
    assert found[1] == found[4] == [] and found[5] == [("hex", 0, 300_000)]
    assert found[2] == [("entropy_mixed", 0, len(long))]
    assert found[3] == [("hex", 2 + 25 * i, 26 + 25 * i) for i in range(5000)]
    clean = {x["doc_id"]: x["text"] for x in secret_scan.redact(documents(spark, rows)).collect()}
    assert clean[1] == rows[0][1] and clean[2] == "[secret]" and clean[3] == "é " + " ".join(["[secret]"] * 5000)


def test_covers_and_places_of_many_matches(spark):
    r = random.Random(2)
    parts = [r.choice(['token = "' + "".join(r.choice(CHARS) for _ in range(r.choice([5, 6, 30]))) + '"', "AKIA" + "Z1" * r.choice([3, 8, 9]), "word", "0af3" * r.choice([5, 6, 9]), "ünï", "snake_case_words_that_are_long"]) for _ in range(300)]
    text = " ".join(parts)
    found = secret_scan.find(documents(spark, [(1, text)])).first()["spans"]
    assert [tuple(s) for s in found] == sorted((tuple(s) for s in found), key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
    base = [s for s in found if s["kind"] in secret_scan.BASE_KINDS]
    for s in found:
        if s not in base:
            assert not any(b["start"] <= s["start"] and s["end"] <= b["end"] for b in base)
    import re
    want = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)] + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]{16,}", text)]
    assert set(want) <= {tuple(s) for s in found}


def test_ids_with_several_texts_lose_only_copies(spark):
    base, alone = prose(70, 80), prose(71, 80)
    rows = [(1, base), (2, base + " tail"), (2, alone), (3, None), (2, base + " tail")]
    docs = documents(spark, rows)
    kept = sorted((x["doc_id"], x["text"] or "") for x in neardup.deduplicate(docs, words=5, percent=80).collect())
    assert kept == [(1, base), (2, alone), (3, "")]
    assert sorted(map(tuple, neardup.near_duplicates(docs, words=5, percent=80).collect()), key=repr) == brute_near(rows, 5, 80)


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90, 99])
def test_trees_keep_the_miss_at_the_threshold(percent):
    trees, share = neardup.trees_for(percent), percent / 100
    assert (1 - share ** neardup.DEPTH) ** trees <= neardup.MISS < (1 - share ** neardup.DEPTH) ** (trees - 1)


def test_items_without_an_id_hit_words(spark):
    passage = prose(80, 20)
    bench = spark.createDataFrame([(None, passage), (7, prose(81, 20)), (8, None)], "item_id bigint, text string")
    docs = documents(spark, [(1, passage), (2, prose(82, 40)), (3, passage + " " + passage)])
    for words in (2_000_000, 15):
        got = {x["doc_id"]: (x["n_hit"], x["n_items"], x["contaminated"]) for x in decontaminate.digest(decontaminate.find(docs, bench, block_words=words)).collect()}
        assert got == {1: (20, 0, True), 2: (0, 0, False), 3: (40, 0, True)}
        assert [x["doc_id"] for x in decontaminate.decontaminate(docs, bench, block_words=words).collect()] == [2]


def plain_bag(text):
    """Character n-grams of words with their edges, one by one; letters only."""
    low = text.lower()
    words = "".join(c if (c.isascii() and c.isalpha()) or (not c.isascii() and c.isalpha()) else " " for c in low).split()
    out = []
    for w in words:
        edged = f" {w} "
        out += list(w)
        for n in (2, 3, 4):
            out += [g for g in (edged[i:i + n] for i in range(len(edged) - n + 1)) if g.strip()]
    return out


def plain_bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
    x = (h + len(gram)) % (1 << 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) % (1 << 64)
    return (x ^ (x >> 31)) >> (64 - 14)


def test_predictions_equal_the_plain_form(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train_on(docs)
    odd = [(1, None), (2, "12 34 !"), (3, "Été à l'œuvre"), (4, "x"), (5, "ß" * 40), (6, "a1b2 c")]
    rows = odd + [(100 + i, x["text"]) for i, x in enumerate(docs.select("text").where("text IS NOT NULL").limit(40).collect())]
    got = {x["doc_id"]: x for x in language.identify(documents(spark, rows), model).collect()}
    for i, text in rows:
        grams = plain_bag(text or "")
        if not grams:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        mean = np.mean([model.table[plain_bucket(g)].astype(float) for g in grams], axis=0)
        logits = (mean + model.bias) / model.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert got[i]["lang_pred"] == model.languages[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), rel=1e-6)
        assert got[i]["rejected"] == (p.max() < model.least) or abs(p.max() - model.least) < 1e-9


def whole(html):
    tree = Tree(html)
    return tree.text([True] * len(tree.tags))


def test_names_and_ends_of_raw_elements():
    assert whole("<style-guide>kept</style-guide> <script-note>too</script-note>") == "kept too"
    assert whole("<title-bar>t<b>u</b></title-bar>") == "tu"
    assert whole("<svg><style/><text>a</text></svg><p>b</p>") == "a\nb"
    assert whole("<p>hi<title/>there</p><p>on</p>") == "hi\nthere\non"
    assert whole("<script>x</scripty></script>y") == "y"
    assert whole("<p title='a>b'>q</p><p a=\"'\">r</p>") == "q\nr"


@pytest.mark.parametrize("html", ["<a '" * 250_000, "<a \"'" * 200_000, "<b>" * 20_000 + "</i>" * 20_000, "<p><table>" + "<b>" * 20_000 + "<hr>" * 20_000,
                                  "<script" * 140_000, "<title>" * 140_000, "<!--" * 250_000, "<script>" + "</script" * 100_000, "<td>" * 100_000])
def test_markup_is_read_in_linear_time(html):
    began = time.process_time()
    Tree(html)
    assert time.process_time() - began < 10
