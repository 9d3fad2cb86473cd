import hashlib
import random
import zlib

import pytest

from recollect.llm import prefixtrie

from .fixtures import CLASH

NONE = hashlib.sha256(b"").hexdigest()


def table(spark, rows):
    return spark.createDataFrame([r + ("x",) * len(CLASH) for r in rows], "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"{c} string" for c in CLASH))


def turn_id(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def sequences(rows, rebuild):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, turn_id(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    if not rebuild:
        return own
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def words(text):
    return sum(1 for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w)


def brute(seqs):
    if not seqs:
        return []
    members, children = {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
            if d:
                children.setdefault(tuple(s[:d - 1]), set()).add(tuple(s[:d]))
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, ())
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(members[k]) - 1) * (words(k[-1][1]) if k else 0) + sum(saved[x] for x in below)
    out = []
    for k, m in members.items():
        ends = sorted(c for c in m if len(seqs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, ())), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(seed=1):
    r = random.Random(seed)
    texts = ["one two", "three\tfour  five", "", None, "six", "é è ê"]
    out = []
    for c in [*range(0, 60), 77, -3, -25, 1000]:
        for t in range(r.choice([0, 1, 2, 3, 5, 9])):
            out.append((c, t, r.choice(["user", "assistant", None]), r.choice(texts)))
    out += [(c, t, "user", f"hot {t}") for c in range(200, 260) for t in range(12)]
    out += [(c, t, "user", f"hot {t}") for c in range(300, 330) for t in range(12 + c % 7)]
    out += [(c, t, "user", f"long {t if t < 30 else (t, c % 3)}") for c in range(400, 406) for t in range(40)] + [(407, t, "user", f"long {t}") for t in range(24)]
    out += [(500, None, "a", "null first"), (500, None, "a", "null first"), (500, 3, "b", "x"), (500, 3, "a", "x"), (500, 1, "c", "w " * 5000), (None, 1, "user", "no conversation"), (501, 0, "u", "ab"), (502, 0, "ua", "b")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("span, limit", [(64, 2000), (4, 3), (8, 10), (2, 1)])
def test_trie_matches_brute_force(spark, span, limit):
    rows = talk()
    got = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turns(table(spark, rows))), span, limit)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(sequences(rows, True))


def test_conversations_as_they_are(spark):
    rows = talk(2)
    got = prefixtrie.trie(prefixtrie.whole(prefixtrie.turns(table(spark, rows))), 5, 4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(sequences(rows, False))


def test_query_on_small_and_empty_tables(spark):
    rows = talk(3)[:50]
    assert sorted(map(tuple, prefixtrie.digest(table(spark, rows)).collect()), key=repr) == brute(sequences(rows, True))
    assert prefixtrie.digest(table(spark, rows).where("conv_id > 10000")).collect() == []
