"""The prefix trie of conversations as burst tries: containers of suffixes under trie heads, burst by turn id, then swept.

A conversation is a sequence of turn ids (128 bits of a hash of role and text). Sequences are cut into layers of
``span`` turns, so that no row grows with a conversation; a prefix is named by its depth and two 64-bit hashes, each
the exclusive-or of a hash of every (place, turn id), so the names of all layers' heads come from one sum over layers.
Equal segments of a layer under equal heads are one suffix with a weight, before anything else is done with them.

A container holds the suffixes under one head; at first the head is the prefix at the start of the layer. A container
with more than ``limit`` different suffixes bursts: its head becomes a trie head, and its suffixes move to containers one
turn deeper, by their next turn id. This goes on for oversized containers alone until there are none, at most ``span``
times. The remaining containers are dealt into shards, sorted, and swept: a task walks the sorted suffixes with a stack
of open nodes and has one container of at most ``limit`` suffixes in memory.

What a node sums over its subtree may lie in containers below it. So containers are swept twice: first for their totals
and links, which are then summed along the links by doubling (as many rounds as the logarithm of the layers), and
then, with the totals of the containers below at hand, for their nodes.

Defined cases: rows without ``conv_id`` belong to no conversation; turns with equal numbers are ordered by their turn
ids; a null role or text is empty; a conversation without turns ends at the root; an empty table gives no rows, for there
is no conversation at the root; other columns are ignored. The hash of all members that end at a node is
streamed over their sorted ids, so it holds one of them at a time.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recollect.llm.frames import drop, stage, stage_narrow
from recollect.llm.ranks import numbered

#: Turns of a layer; suffixes of a container that is swept.
SPAN, LIMIT = 64, 2000
KEY = ["depth", "p", "q"]
NONE = hashlib.sha256(b"").hexdigest()
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def turns(rows: DataFrame) -> DataFrame:
    """(conv, i, id, words): turns of every conversation, numbered from 0; texts are read once and left behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("id"),
        F.regexp_count(text, F.lit(SPACE_WORD)).cast("bigint").alias("words"))
    return numbered(narrow, ["conv"], [F.asc_nulls_first("turn"), "id"], "i", "size").select("conv", "i", "id", "words", "size")


def _lanes(id: Column, i: Column) -> tuple[Column, Column]:
    return F.xxhash64(id, i.cast("bigint"), F.lit(1)), F.xxhash64(id, i.cast("bigint"), F.lit(2))


def rebuilt(found: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Sequences in which conversation c starts with the first h turns of c - c % ``group`` and goes on after its own first h, h = crc32(c) % ``most``.

    (conv, i, id, words), and a row without id where the conversation ends.
    """
    def h(conv: Column) -> Column:
        return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(most))

    convs = stage_narrow(found.groupBy("conv").agg(F.max("size").alias("size")).select("*", (F.col("conv") - F.col("conv") % group).alias("base"), h(F.col("conv")).alias("h")), "conversations")
    convs = stage_narrow(convs.join(convs.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("lent"), F.greatest(F.lit(0), F.col("size") - F.col("h")).alias("own")), "heads")
    first = found.where((F.col("i") < most - 1) & (F.col("conv") % group == 0)).select(F.col("conv").alias("base"), "i", "id", "words")
    lent = convs.join(first, "base").where("i < h").select("conv", "i", "id", "words")
    own = found.join(convs, "conv").where("i >= h").select("conv", (F.col("i") - F.col("h") + F.col("lent")).alias("i"), "id", "words")
    ends = convs.select("conv", (F.col("lent") + F.col("own")).alias("i"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("bigint").alias("words"))
    return lent.unionByName(own).unionByName(ends)


def whole(found: DataFrame) -> DataFrame:
    """Sequences of the conversations as they are."""
    ends = found.where("i = 0").select("conv", F.col("size").alias("i"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("bigint").alias("words"))
    return found.select("conv", "i", "id", "words").unionByName(ends)


def segments(sequences: DataFrame, span: int) -> DataFrame:
    """(conv, layer, p, q, end_p, end_q, ids, words, lead, last): one row a layer; ``p, q`` name its head, ``lead`` are the words of the head's turn."""
    lanes = _lanes(F.col("id"), F.col("i"))
    own = stage(sequences.groupBy("conv", F.floor(F.col("i") / span).alias("layer")).agg(
        F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("i", "id", "words")))).alias("row"),
        *(F.coalesce(F.bit_xor(F.when(F.col("id").isNotNull(), h)), F.lit(0)).alias(c) for h, c in zip(lanes, ("own_p", "own_q"))),
        F.bool_or(F.col("id").isNull()).alias("last")), "layers")
    layers = Window.partitionBy("conv").orderBy("layer")
    before = layers.rowsBetween(Window.unboundedPreceding, -1)
    narrow = own.select("conv", "layer", "own_p", "own_q", F.try_element_at("row.words", F.lit(-1)).alias("words"))
    head = narrow.select("conv", "layer", *(F.coalesce(F.bit_xor(f"own_{c}").over(before), F.lit(0)).alias(c) for c in "pq"), F.coalesce(F.lag("words").over(layers), F.lit(0)).alias("lead"))
    return own.join(stage_narrow(head, "layer-heads"), ["conv", "layer"]).select(
        "conv", "layer", "p", "q", *(F.col(c).bitwiseXOR(F.col(f"own_{c}")).alias(f"end_{c}") for c in "pq"), F.col("row.id").alias("ids"), F.col("row.words").alias("words"), "lead", "last")


def endings(found: DataFrame) -> DataFrame:
    """(layer, end_p, end_q, ends_sha256): for each node at which conversations end, the hash of their ids in order."""
    key = ["layer", "end_p", "end_q"]
    rows = found.where("last").select(*key, "conv").repartition(*key).sortWithinPartitions(*key, "conv")
    target = pa.schema([("layer", pa.int64()), ("end_p", pa.int64()), ("end_q", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            out = []
            for *now, conv in zip(*(c.to_pylist() for c in b.columns)):
                if now != at:
                    if h:
                        out.append((*at, h.hexdigest()))
                    at, h = now, hashlib.sha256(str(conv).encode())
                else:
                    h.update(f",{conv}".encode())
            yield _batch(out, target)
        if h:
            yield _batch([(*at, h.hexdigest())], target)

    return rows.mapInArrow(run, "layer bigint, end_p bigint, end_q bigint, ends_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def suffixes(found: DataFrame, span: int) -> DataFrame:
    """Different segments under their heads with weight ``n`` and smallest member; ``over`` are the words after which the layer ends.

    (depth, p, q) name the head of the container, (end_depth, end_p, end_q) the prefix at the segment's end, ``at`` how many turns of it lie above the head.
    """
    key = ["layer", "end_p", "end_q", "last"]
    one = found.groupBy(*key).agg(F.count("*").alias("n"), F.min("conv").alias("conv"), *(F.any_value(c).alias(c) for c in ("p", "q", "ids", "words", "lead")))
    ends = endings(found).select("*", F.lit(True).alias("last"))
    one = stage_narrow(one, "segments").join(stage_narrow(ends, "endings"), key, "left")
    return one.select((F.col("layer") * span).alias("depth"), "p", "q", (F.col("layer") * span + F.size("ids")).alias("end_depth"), "end_p", "end_q",
                      F.lit(0).alias("at"), "ids", "words", "lead", "last", "n", "conv", "ends_sha256")


def burst(rows: DataFrame, span: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Containers of at most ``limit`` suffixes; trie heads; links (depth, p, q, up_depth, up_p, up_q, parent_conv) from burst heads to containers below."""
    done, heads, links = [], [], []
    rows = stage(rows, "suffixes")
    while True:
        sizes = rows.groupBy(*KEY).count().where(F.col("count") > limit).select(*KEY, F.lit(True).alias("large"))
        if sizes.isEmpty():
            done.append(rows)
            break
        dealt = stage(rows.join(stage_narrow(sizes, "large"), KEY, "left"), "dealt")
        done.append(dealt.where("large IS NULL").drop("large"))
        large = dealt.where("large").drop("large")
        here = F.size("ids") == F.col("at")
        heads.append(stage_narrow(large.groupBy(*KEY).agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max(F.when(here, F.col("ends_sha256"))).alias("ends_sha256"),
            F.any_value(F.when(F.col("at") == 0, F.col("lead")).otherwise(F.get("words", F.col("at") - 1))).alias("words")), "heads"))
        deeper = large.where(~here)
        next_id = F.get("ids", F.col("at"))
        lanes = _lanes(next_id, F.col("depth"))
        deeper = deeper.select("*", *(F.col(c).alias(f"up_{c}") for c in KEY)).withColumns(
            {"depth": F.col("depth") + 1, "at": F.col("at") + 1} | {c: F.col(c).bitwiseXOR(h) for c, h in zip("pq", lanes)})
        deeper = stage(deeper, "deeper")
        down = deeper.select(*KEY, *(f"up_{c}" for c in KEY)).distinct()
        links.append(stage_narrow(down.join(heads[-1].select(*(F.col(c).alias(f"up_{c}") for c in KEY), F.col("conv").alias("parent_conv")), [f"up_{c}" for c in KEY]), "burst-links"))
        drop(rows)
        rows = deeper.drop(*(f"up_{c}" for c in KEY)).where((F.col("at") < span))
    return _all(done), _all(heads), _all(links)


def _all(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


class _Node:
    __slots__ = ("depth", "words", "n", "conv", "ends", "children", "leaves", "saved", "below")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.n, self.conv, self.ends, self.children, self.leaves, self.saved, self.below = depth, words, 0, None, None, 0, 0, 0, []


def sweep(depth: int, rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Nodes and links of one container from its sorted suffixes (ids, words, last, n, conv, ends, lead, end key, leaves and saved below).

    Nodes are (is head, conv, depth, parent's conv, n, children, leaves, saved, ends); links are (end key, parent's conv).
    A suffix that isn't the last of its conversations goes on in the container named by its end; its last turn makes no node here.
    """
    nodes, links = [], []
    stack = [_Node(depth, rows[0][6])]
    path: list = []

    def close() -> None:
        x = stack.pop()
        x.saved += (x.n - 1) * x.words
        if not x.children:
            x.leaves = 1
        up = stack[-1] if stack else None
        for kind, y in x.below:
            if kind:
                nodes.append((False, y.conv, y.depth, x.conv, y.n, y.children, y.leaves, y.saved, y.ends))
            else:
                links.append((y, x.conv))
        if up is None:
            nodes.append((True, x.conv, x.depth, None, x.n, x.children, x.leaves, x.saved, x.ends))
        else:
            up.n, up.children, up.leaves, up.saved = up.n + x.n, up.children + 1, up.leaves + x.leaves, up.saved + x.saved
            up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
            up.below.append((True, x))
    for ids, words, last, n, conv, ends, _, end, leaves, saved in rows:
        own = ids if last else ids[:-1]
        same = 0
        while same < len(path) and same < len(own) and path[same] == own[same]:
            same += 1
        while len(stack) - 1 > same:
            close()
        for k in range(same, len(own)):
            stack.append(_Node(depth + k + 1, words[k]))
        path = own
        top = stack[-1]
        top.n += n
        top.conv = conv if top.conv is None else min(top.conv, conv)
        if last:
            top.ends = ends
        else:
            top.children, top.leaves, top.saved = top.children + 1, top.leaves + (leaves or 0), top.saved + (saved or 0)
            top.below.append((False, end))
    while stack:
        close()
    return nodes, links


_SWEPT = ("head boolean, depth bigint, p bigint, q bigint, conv bigint, node_depth bigint, parent_conv bigint, n bigint, children bigint, leaves bigint, saved bigint, ends_sha256 string, "
          "down_depth bigint, down_p bigint, down_q bigint")


def swept(rows: DataFrame) -> DataFrame:
    """Nodes of all containers, and a row with ``down_*`` for each link to a container below."""
    target = pa.schema([(f.split()[0], {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in _SWEPT.split(", ")])
    rest = F.size("ids") - F.col("at")
    shard = rows.select(*KEY, *(F.slice(c, F.col("at") + 1, rest).alias(c) for c in ("ids", "words")), "last", "n", "conv", "ends_sha256",
                        F.when(F.col("at") == 0, F.col("lead")).otherwise(F.get("words", F.col("at") - 1)).alias("lead"), "end_depth", "end_p", "end_q", "leaves", "saved")
    shard = shard.repartition(*KEY).sortWithinPartitions(*KEY, "ids")

    def result(key: tuple, rows: list[tuple]) -> list[tuple]:
        nodes, links = sweep(key[0], rows)
        return [(x[0], *key, *x[1:], None, None, None) for x in nodes] + [(None, *key, *[None] * 2, conv, *[None] * 5, *down) for down, conv in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            out = []
            for depth, p, q, ids, words, last, n, conv, ends, lead, *end, leaves, saved in zip(*(c.to_pylist() for c in b.columns)):
                if (depth, p, q) != at:
                    if held:
                        out += result(at, held)
                    at, held = (depth, p, q), []
                held.append((ids, words, last, n, conv, ends, lead, tuple(end), leaves, saved))
            yield _batch(out, target)
        if held:
            yield _batch(result(at, held), target)

    return shard.mapInArrow(run, _SWEPT)


def totals(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(depth, p, q, leaves, saved) with what lies below each container added, by doubling the distance of the links."""
    up = [f"up_{c}" for c in KEY]
    now = stage_narrow(cells.join(links.select(*KEY, *up), KEY, "left"), "cells")
    while not now.where("up_depth IS NOT NULL").isEmpty():
        below = stage_narrow(now.where("up_depth IS NOT NULL").groupBy(*up).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnsRenamed(dict(zip(up, KEY))), "below")
        above = now.select(*(F.col(c).alias(f"up_{c}") for c in KEY), *(F.col(f"up_{c}").alias(f"next_{c}") for c in KEY))
        now = stage_narrow(now.join(below, KEY, "left").join(above, up, "left").select(
            *KEY, (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            *(F.col(f"next_{c}").alias(f"up_{c}") for c in KEY)), "totals")
    return now.select(*KEY, "leaves", "saved")


def trie(sequences: DataFrame, span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): every node of the trie, named by its smallest member."""
    none = F.lit(None).cast("bigint")
    rest, heads, down = burst(suffixes(stage(segments(sequences, span), "layers-of-conversations"), span), span, limit)
    first = stage_narrow(swept(rest.withColumns({"leaves": none, "saved": none})), "cells")
    links = first.where("down_depth IS NOT NULL").select(*(F.col(f"down_{c}").alias(c) for c in KEY), *(F.col(c).alias(f"up_{c}") for c in KEY), "parent_conv")
    cells = first.where("head").select(*KEY, "leaves", "saved")
    if heads is not None:
        links = links.unionByName(down)
        cells = cells.unionByName(heads.select(*KEY, F.lit(0).cast("bigint").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved")))
    summed = totals(cells, links)
    below = summed.select(*(F.col(c).alias(f"end_{c}") for c in KEY), "leaves", "saved")
    on = rest.where("NOT last").join(below, [f"end_{c}" for c in KEY]).select(*rest.columns, "leaves", "saved")
    nodes = stage(swept(rest.where("last").withColumns({"leaves": none, "saved": none}).unionByName(on)).where("head IS NOT NULL"), "nodes")
    inner = nodes.where("NOT head")
    tops = nodes.where("head").drop("parent_conv")
    if heads is not None:
        children = down.groupBy(*(F.col(f"up_{c}").alias(c) for c in KEY)).agg(F.count("*").alias("children"))
        tops = tops.unionByName(heads.join(children, KEY).join(summed, KEY).select("*", F.col("depth").alias("node_depth")), allowMissingColumns=True)
    tops = tops.join(links.select(*KEY, "parent_conv"), KEY, "left")
    return inner.unionByName(tops, allowMissingColumns=True).select(
        F.col("conv").alias("conv_id"), F.col("node_depth").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(stage_narrow(rebuilt(stage_narrow(turns(conversations), "turns")), "sequences"))
