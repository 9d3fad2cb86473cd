import random
import zlib

import pytest

from recollect.llm import merkle, ranks

from .fixtures import CLASH

sha = merkle.sha


def table(spark, rows):
    full = [r + ("x",) * len(CLASH) for r in rows]
    return spark.createDataFrame(full, "doc_id bigint, source string, lang string, n_chars bigint, text string, " + ", ".join(f"{c} string" for c in CLASH))


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for s in by:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in by}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h, proof = leaf(r[:4] + (r[4].replace("\n", ""),)) if bad else leaf(r), []
            for tree, at in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    run = level[at - at % 3:at - at % 3 + 3]
                    proof += [x for j, x in enumerate(run) if j != at % 3]
                    h = sha("".join(h if j == at % 3 else x for j, x in enumerate(run)))
                    at //= 3
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(proof)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(n, seed=1):
    r = random.Random(seed)
    out = [(i, r.choice(["hot", "hot", "hot", "a", "b", "é", "z", None]), r.choice(["en", None]), r.choice([i, None]), r.choice([None, "", "one\ntwo", f"t{i}\n", "x" * 9])) for i in range(n)]
    out += [(None, "hot", None, None, "a\nb"), (None, "hot", None, None, "a\nb"), (None, None, None, None, None), (3, "only", "en", 5, "lone\n"), (7, "hot", "en", 1, "other"), (7, "hot", "en", 1, "other"),
            (10 ** 12, "", "en", 2, "y\n" * 50_000), (-4, "~", "en", 1, "\n")]
    return out


@pytest.mark.parametrize("n, depth", [(300, 6), (300, 1), (40, 2), (0, 1)])
def test_proofs_match_brute_force(spark, n, depth):
    rows = rows_of(n)
    even = "crc32(cast(doc_id AS string)) % 2 = 0"
    from pyspark.sql import functions as F
    found = merkle.leaves(table(spark, rows), tampered={"text": F.replace("text", F.lit("\n"))}, when=F.expr(even))
    m = merkle.Manifest(found, depth)
    got = merkle.prove(m)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == brute(rows)
    for r in got.collect():
        assert sha("".join(r["proof"])) == r["proof_sha256"]
    assert {r["root"] for r in got.select("root").collect()} == {m.root().first()["root"]}


def test_query_matches_brute_force_and_empty_table(spark):
    rows = rows_of(1500, 2)
    assert sorted(map(tuple, merkle.digest(table(spark, rows)).collect()), key=repr) == brute(rows)
    assert merkle.digest(table(spark, rows[:1]).where("doc_id < 0")).collect() == []


def test_missing_is_the_least_set_that_proves_all(spark):
    r = random.Random(3)
    for n in (1, 2, 3, 4, 9, 10, 28, 100, 243):
        tree = levels([sha(str(i)) for i in range(n)])
        for _ in range(20):
            known = set(r.sample(range(n), r.randint(1, n)))
            want = merkle.missing(n, known)
            nodes = {(0, i): tree[0][i] for i in known} | {(a, i): tree[a][i] for a, i in want}
            merkle.derive(n, nodes)
            assert nodes[len(tree) - 1, 0] == tree[-1][0]
            for i in known:
                assert merkle.folded(tree[0][i], merkle.sides(n, nodes, i)) == tree[-1][0]
            for gone in want:
                less = {(0, i): tree[0][i] for i in known} | {(a, i): tree[a][i] for a, i in want if (a, i) != gone}
                merkle.derive(n, less)
                assert (len(tree) - 1, 0) not in less


def test_places_by_ranges(spark):
    r = random.Random(4)
    rows = [(r.choice("aaab"), r.choice([None, 1, 2, 3, r.randint(0, 99)])) for _ in range(500)]
    got = ranks.numbered(spark.createDataFrame(rows, "g string, x int"), ["g"], ["x"]).collect()
    for g in "ab":
        own = sorted((x for h, x in rows if h == g), key=lambda x: (x is not None, x or 0))
        placed = sorted((y["pos"], y["x"]) for y in got if y["g"] == g) if None not in own else sorted(((y["pos"], y["x"]) for y in got if y["g"] == g), key=lambda p: p[0])
        assert [x for _, x in placed] == own and [p for p, _ in placed] == list(range(len(own))) and {y["size"] for y in got if y["g"] == g} == {len(own)}
