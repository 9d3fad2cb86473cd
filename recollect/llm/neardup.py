"""MinHash near-dedup with an LSH forest: several sorted signature orders, longest-common-prefix neighbours, adaptive depth.

1. Every document becomes its set of word shingles, the set's 128-bit digest and its MinHash signature. Documents with
   equal sets are one class; everything below runs on classes, so exact copies cost nothing more.
2. A tree of the forest orders the classes by a rotation of the signature. Classes that share ``depth`` values in no
   tree with any other leave. The others lie in regions of classes that share so many values, and in deeper regions of
   these. First every class is held against the densest class of each of its regions, the region's representative.
   Candidates are confirmed on full sets, and links become components.
3. Classes that are in a component with their representatives are done there. All others are held against their
   neighbours in the sorted order of each tree, whose common prefix is the longest, and against several dense classes
   of each region, as far as these are in other components. In a region of at most ``SMALL`` classes every class is
   held against every other one of another component.
4. A larger region whose classes aren't all in one component by then is finished by a prefix-filter join on the
   rarest shingles of full sets. Its pairs pass the test on signatures as well, as all candidates do.

The number of trees follows from the similarity: two sets at the threshold miss each other in all trees, at depth 4,
with a probability of at most ``MISS`` (20 trees at 85 percent, 28 at 80).

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; fewer words than a
shingle are one shingle; rows with equal ids are separate documents; a null id stays null and is kept; ties go to the
smallest id; an empty table gives an empty result; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from recollect.llm.components import components
from recollect.llm.frames import arrow_map, doc_bytes, stage, stage_narrow
from recollect.llm.hashing import LOWER, NOT_SPACE, mix, windows, word_bounds, word_hashes

DEPTH, DEEPEST = 4, 8
#: Greatest probability that two sets at the threshold share a region of no tree.
MISS = 4e-7
#: Bytes of a signature value.
WIDTH = 4
#: Classes of a region up to which all of its pairs are candidates; larger ones are finished by ``crowded_links``.
SMALL = 8
#: Buckets, as bits, in which shingles are counted to tell rare ones from frequent ones.
RARITY_BITS = 20
#: Rows of one shingle from which on its join is dealt over several tasks.
HOT_ROWS = 1024


def trees_for(percent: int) -> int:
    """The least number of trees with which a pair at the threshold is missed by ``MISS`` at most."""
    share = min(max(percent, 1), 99) / 100
    return ceil(log(MISS) / log(1 - share ** DEPTH))


@cache
def _family(trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the hash functions."""
    n = trees * DEPTH
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return seeds[:n, None] | np.uint64(1), seeds[n:, None]


def shingles(data: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    low = LOWER[np.frombuffer(data or b"", dtype=np.uint8)]
    starts, ends = word_bounds(NOT_SPACE[low])
    hashes = word_hashes(low, starts, ends)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    return np.unique(windows(hashes, width) + np.uint64(width))


def signature(values: np.ndarray, trees: int) -> bytes:
    """The least value under each of the hash functions, upper half, big-endian so that bytes sort as numbers."""
    factors, offsets = _family(trees)
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(least, (values[None, at:at + 1024] * factors + offsets).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def digest_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, trees: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_id, n, cls, sig) of every row; cls and sig are null for an empty set."""
    def step(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column(0), "text_id": batch.column(2), "n": [], "cls": [], "sig": []}
        for data in batch.column(1):
            s = shingles(data.as_py(), words)
            out["n"].append(len(s))
            out["cls"].append(digest_of(s) if len(s) else None)
            out["sig"].append(signature(s, trees) if len(s) else None)
        return out

    return arrow_map(doc_bytes(docs, id_col, text_col, _text_id(text_col)), step, "doc_id bigint, text_id binary, n bigint, cls binary, sig binary", rows=500)


def _text_id(text_col: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))).alias("text_id")


def orders(classes: DataFrame, trees: int) -> DataFrame:
    """(tree, key, cls): each class once in every tree; key is the tree's rotation of the signature, to the deepest level."""
    whole = F.concat("sig", F.substring("sig", 1, WIDTH * DEEPEST))
    key = lambda t: F.substring(whole, t * WIDTH * DEPTH + 1, F.lit(WIDTH * DEEPEST))
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), key(t).alias("key")))
    return classes.select("cls", F.explode(each).alias("x")).select("x.tree", "x.key", "cls")


def _region(depth: int) -> F.Column:
    return F.xxhash64("tree", F.lit(depth), F.substring("key", 1, WIDTH * depth))


def alive(classes: DataFrame, trees: int) -> DataFrame:
    """The classes that share a region of least depth with another one, with their signatures."""
    rows = orders(classes, trees).select(_region(DEPTH).alias("region"), "cls")
    shared = stage_narrow(rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region"), "regions-of-several")
    return classes.join(rows.join(shared, "region", "left_semi").select("cls").distinct(), "cls", "left_semi")


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def shared_regions(forest: DataFrame) -> DataFrame:
    """(region, cls, least, n): the regions of several classes at several depths; ``least``: at the least depth, ``n``: how many classes."""
    levels = F.array(*[F.struct(_region(k).alias("region"), F.lit(k == DEPTH).alias("least")) for k in range(DEPTH, DEEPEST + 1, 2)])
    rows = stage_narrow(forest.select("cls", F.explode(levels).alias("x")).select("cls", "x.region", "x.least"), "regions")
    counts = stage_narrow(rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1"), "region-sizes")
    return stage_narrow(rows.join(counts, "region"), "shared-regions")


def representatives(within: DataFrame) -> DataFrame:
    """(a, b): each class with the densest class of every region it lies in.

    A class is dense if its regions are large: the text that others were derived from lies in more of their regions
    than they lie in each other's. One class represents most of its regions, so a class meets few of them.
    """
    top = within.join(_density(within), "cls").groupBy("region").agg(F.max(F.struct("density", "cls")).alias("top"))
    top = stage_narrow(top.select("region", F.col("top.cls").alias("top")), "representatives")
    return within.join(top, "region").where("cls != top").select(*_pair(F.col("cls"), F.col("top"))).distinct()


def _density(within: DataFrame) -> DataFrame:
    return stage_narrow(within.groupBy("cls").agg(F.sum("n").alias("density")), "density")


def leaders(within: DataFrame, several: int = 4) -> DataFrame:
    """(a, b): classes with the ``several`` densest classes of every region they lie in, and with all of a small region, in other components.

    ``within`` has the ``root`` of every class; regions that lie in one component have nothing to add.
    """
    divided = within.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("region")
    within = stage_narrow(within.join(stage_narrow(divided, "divided-regions"), "region"), "in-divided-regions")
    # many classes of a large region tie; each region draws its own of them, so that a class meets most of the densest
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("density"), F.xxhash64("region", "cls"), "cls"))
    first = within.join(_density(within), "cls").withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("n") <= SMALL, SMALL).otherwise(several))
    first = stage_narrow(first.select("region", F.col("cls").alias("top"), F.col("root").alias("top_root")), "leaders")
    on = (within["region"] == first["region"]) & (within["root"] != first["top_root"])
    return within.join(first, on).select(*_pair(F.col("cls"), F.col("top"))).distinct()


def neighbours(forest: DataFrame, reach: int = 3) -> DataFrame:
    """(a, b): classes next to each other in the sorted order of a tree, with a common prefix of the least depth, in different components.

    ``forest`` has the ``root`` of every class.
    The order is dealt by ranges, so a region of any size spreads over tasks. The first and last rows of each range
    go through one more small pass, which sees the neighbours across the borders.
    """
    ordered = forest.select("tree", "key", "cls", "root").repartitionByRange("tree", "key", "cls").sortWithinPartitions("tree", "key", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, head, border, n = [], [], [], 0
        for batch in batches:
            a, b = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                n += 1
                for old in last:
                    if old[0] == row[0] and old[1][:WIDTH * DEPTH] == row[1][:WIDTH * DEPTH] and old[3] != row[3]:
                        a.append(min(old[2], row[2]))
                        b.append(max(old[2], row[2]))
                if n <= reach:
                    head.append(row)
                last = [*last, row][-reach:]
            yield _rows(a, b, *[[None] * len(a)] * 5)
        border = head + [x for x in last if x not in head]
        yield _rows([None] * len(border), [None] * len(border), [part] * len(border), *map(list, zip(*border)) if border else ([], [], [], []))

    def _rows(*columns):
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["a", "b", "part", "tree", "key", "cls", "root"])

    found = stage_narrow(ordered.mapInArrow(run, "a binary, b binary, part int, tree int, key binary, cls binary, root binary"), "neighbours")
    border = found.where("part IS NOT NULL").select("tree", "key", "cls", "root").distinct()
    across = border.groupBy("tree", F.substring("key", 1, WIDTH * DEPTH).alias("k")).agg(F.sort_array(F.collect_list(F.struct("key", "cls", "root"))).alias("x"))
    near = lambda k: across.where(F.size("x") > k).select(F.explode(F.arrays_zip(F.slice("x", 1, F.size("x") - k).alias("p"), F.slice("x", 1 + k, F.size("x") - k).alias("q"))).alias("z")).where("z.p.root != z.q.root").select(*_pair(F.col("z.p.cls"), F.col("z.q.cls")))
    pairs = found.where("a IS NOT NULL").select("a", "b")
    for k in range(1, reach + 1):
        pairs = pairs.unionByName(near(k))
    return pairs.distinct()


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, same): pairs whose sizes allow the similarity and whose signatures agree within five standard deviations of it.

    One byte of each signature value is enough here; chance agreement only lets more pairs through.
    """
    share, hashes = percent / 100, trees_for(percent) * DEPTH
    least = hashes * share - 5 * (hashes * share * (1 - share)) ** 0.5

    def narrow(batch: pa.RecordBatch) -> dict:
        values = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, hashes, WIDTH)
        return {"cls": batch.column(0), "n": batch.column(1), "bytes": [x.tobytes() for x in values[:, :, -1]]}

    short = arrow_map(classes.select("cls", "n", "sig"), narrow, "cls binary, n bigint, bytes binary")
    side = lambda c: short.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bytes").alias(f"bytes_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def step(batch: pa.RecordBatch) -> dict:
        p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, hashes) for c in ("bytes_a", "bytes_b"))
        same = (p == q).sum(axis=1)
        keep = pa.array(same >= least)
        return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep), "same": same[same >= least]}

    return arrow_map(joined, step, "a binary, b binary, same int")


def full_sets(members: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, items): the shingle sets of the classes. ``members``: (cls, low), the smallest id of each class."""
    ids = members.select(F.col("low").alias("doc_id")).distinct()
    # ids grow with the corpus: one plan at every size, instead of a broadcast while they happen to be few
    texts = doc_bytes(docs, id_col, text_col).join(ids.hint("merge"), "doc_id", "left_semi")

    def build(batch: pa.RecordBatch) -> dict:
        sets = [shingles(x.as_py(), words) for x in batch.column(1)]
        return {"cls": [digest_of(s) for s in sets], "items": [s.tobytes() for s in sets]}

    return arrow_map(texts, build, "cls binary, items binary", rows=500).join(members.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("items").alias("items"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("items").alias(f"items_{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def step(batch: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(batch.column("items_a"), batch.column("items_b")):
            p, q = (np.frombuffer(z.as_py(), dtype=np.uint64) for z in (x, y))
            both = np.sort(np.concatenate((p, q)), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(p) + len(q) - common))
        keep = pa.array(keep, pa.bool_())
        return {c: batch.column(c).filter(keep) for c in ("a", "b")}

    return arrow_map(joined, step, "a binary, b binary", rows=500)


def rarity(sets: DataFrame) -> np.ndarray:
    """How often shingles of each bucket occur. It only orders shingles, so collisions cost time and change no result."""
    def count(batch: pa.RecordBatch) -> dict:
        values = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64)
        buckets, n = np.unique(values >> np.uint64(64 - RARITY_BITS), return_counts=True)
        return {"bucket": buckets.astype(np.int64), "n": n}

    table = arrow_map(sets.select("items"), count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, cls, root, n, at, short): the rarest shingles of each set, as many as one of them must be shared by two similar sets.

    A partner shares at least ``percent`` of a set's n shingles, so one of the first n - that + 1; of the smaller of two
    sets, with at least 2 percent / (100 + percent) n in common, fewer do (``short``). ``at`` is the place in the order.
    """
    often = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def step(batch: pa.RecordBatch) -> dict:
        tokens, of, at, short, sizes = [], [], [], [], []
        for k, data in enumerate(batch.column("items").to_pylist()):
            values = np.frombuffer(data, dtype=np.uint64)
            n = len(values)
            long = n - -(-percent * n // 100) + 1
            order = np.lexsort((values, often.value[values >> np.uint64(64 - RARITY_BITS)]))[:long]
            tokens.append(values[order].view(np.int64))
            of.append(np.full(len(order), k))
            at.append(np.arange(len(order)))
            short.append(np.arange(len(order)) < n - -(-2 * percent * n // (100 + percent)) + 1)
            sizes.append(np.full(len(order), n))
        of = pa.array(np.concatenate(of))
        return {"token": np.concatenate(tokens), "cls": batch.column("cls").take(of), "root": batch.column("root").take(of),
                "n": np.concatenate(sizes), "at": np.concatenate(at), "short": np.concatenate(short)}

    return arrow_map(sets.select("cls", "root", "items"), step, "token bigint, cls binary, root binary, n bigint, at bigint, short boolean", rows=2000)


def sharing(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes of different roots that share a shingle of their prefixes at places which allow the similarity.

    Rows of a frequent shingle are dealt by their class, and their partners go to every part.
    """
    several = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo < hi")
    parts = F.ceil(F.col("rows") / HOT_ROWS).cast("int")
    shared = stage(rows.join(stage_narrow(several.select("token", parts.alias("parts")), "shared-shingles"), "token"), "shared-prefixes")
    side = lambda df, c: df.select("token", "salt", *[F.col(x).alias(f"{x}_{c}") for x in ("cls", "root", "n", "at")])
    small = side(shared.where("short").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")), "p")
    large = side(shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "q")
    common = F.least(F.col("n_p") - F.col("at_p"), F.col("n_q") - F.col("at_q"))  # at most, as all before differ
    fits = (F.col("root_p") != F.col("root_q")) & ((F.col("n_p") < F.col("n_q")) | ((F.col("n_p") == F.col("n_q")) & (F.col("cls_p") < F.col("cls_q")))) \
        & (100 * F.col("n_p") >= percent * F.col("n_q")) & ((100 + percent) * common >= percent * (F.col("n_p") + F.col("n_q")))
    on = (small["token"] == large["token"]) & (small["salt"] == large["salt"]) & fits
    return small.join(large, on).select(*_pair(F.col("cls_p"), F.col("cls_q"))).distinct()


def crowded_links(crowd: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """The links between components inside large regions; none if every large region lies in one component.

    ``crowd``: (region, cls) of regions with more than ``SMALL`` classes. Every pair of their classes that isn't connected
    yet is found if its sets reach the similarity.
    """
    rooted = crowd.join(roots, F.col("cls") == F.col("vertex"), "left").select("region", "cls", F.coalesce("root", "cls").alias("root"))
    rooted = stage_narrow(rooted, "crowd-roots")
    divided = rooted.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("region")
    members = stage_narrow(rooted.join(divided, "region", "left_semi").select("cls", "root").distinct(), "divided-crowd")
    if members.isEmpty():
        return None
    rows = stage(prefixes(stage(sets.join(members, "cls"), "crowd-sets"), percent), "prefixes")
    likely = stage_narrow(plausible(sharing(rows, percent), classes, percent), "crowd-candidates")
    return confirm(likely, sets, percent)


def grouped(found: DataFrame, crowd: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(vertex, root) over the found links and those that large regions add to them."""
    roots = components(found)
    if crowd.isEmpty():
        return roots
    roots = stage_narrow(roots, "roots")
    more = crowded_links(crowd, roots, classes, sets, percent)
    if more is None:
        return roots
    side = lambda c: roots.select(F.col("vertex").alias(c), F.col("root").alias(f"root_{c}"))
    over = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    upper = stage_narrow(components(over), "crowd-roots").select(F.col("vertex").alias("root"), F.col("root").alias("top"))
    # a root is a vertex of its own component, or a class without links so far
    alone = upper.select(F.col("root").alias("vertex"), F.col("top").alias("root")).join(roots.select("vertex"), "vertex", "left_anti")
    return roots.join(upper, "root", "left").select("vertex", F.coalesce("top", "root").alias("root")).unionByName(alone)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("vertex").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def judged(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_id, n_shingles, component_id, kept of every row."""
    trees = trees_for(percent)
    signed = stage(signatures(docs, words, trees, id_col, text_col), "signatures")
    classes = stage(signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    living = stage(alive(classes, trees), "alive")
    forest = orders(living, trees)
    within = shared_regions(forest)
    sets = stage(full_sets(living.select("cls", "low"), docs, words, id_col, text_col), "shingle-sets")
    first = stage_narrow(plausible(representatives(within), living, percent), "first-candidates")
    found = stage_narrow(confirm(first, sets, percent), "first-links")
    roots = stage_narrow(components(found), "first-roots")
    candidates = leaders(_rooted(within, roots)).unionByName(neighbours(_rooted(forest, roots))).distinct()
    likely = stage_narrow(plausible(candidates, living, percent), "candidates")
    found = stage_narrow(found.unionByName(confirm(likely, sets, percent)), "links")
    crowd = stage_narrow(within.where(F.col("least") & (F.col("n") > SMALL)).select("region", "cls"), "crowd")
    roots = grouped(found, crowd, living, sets, percent)
    linked = classes.select("cls", "low").join(roots, F.col("cls") == F.col("vertex"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("least"))
    group = stage_narrow(classes.select("cls", "low").join(linked.select("cls", "root"), "cls", "left").join(lowest, "root", "left")
                  .select("cls", F.coalesce("least", "low").alias("least")), "groups")
    out = signed.select("doc_id", "text_id", "n", "cls").join(group, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "text_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: the smallest id of each group of near-duplicates stays."""
    return judged(docs, words, percent, id_col, text_col).drop("text_id")


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have a near-duplicate of smaller id; columns stay as they are.

    A row goes by its id and its text: another text under the same id is judged by itself. Rows with a null id stay,
    and so do rows that repeat a kept document.
    """
    gone = judged(docs, words, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_id").alias("_text_id")).distinct()
    on = (F.col(id_col).cast("bigint") == F.col("_gone")) & (_text_id(text_col) == F.col("_text_id"))
    return docs.join(gone.hint("merge"), on, "left_anti")
