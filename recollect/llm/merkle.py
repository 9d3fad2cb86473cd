"""A Merkle manifest of documents: trees of arity three by source, a tree over their roots, and proofs of all leaves.

A leaf is the hash of a row's fields. The leaves of a source are numbered in the order of their ids by sorted ranges, so a
source with a third of all rows is many tasks. Trees grow by blocks of nodes: a block's task folds ``levels`` levels
and writes their nodes, then the blocks' tops are dealt into blocks in turn.

Proofs are made as an octopus multiproof. A leaf partition is one block. From the places of its leaves alone it knows
the coordinates (tree, level, place) that its own leaves can't derive, up to the root of its source and on to the
root of all: ``missing`` gives their minimal union. These nodes are fetched once for the partition, in one join of
coordinates with nodes. Then a task with the partition's leaves and the fetched nodes derives the interiors that
proofs share and expands every leaf's proof from them.

Defined cases: a null field is ``-``; null ids come first and are never tampered with; rows with equal ids are leaves of
their own, in the order of their hashes; the null source is a tree and comes first; an empty table has no rows;
other columns are ignored.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recollect.llm.frames import stage, stage_narrow
from recollect.llm.ranks import numbered

ARITY = 3
#: Levels of a block: 729 leaves.
LEVELS = 6
#: The tree of all subroots; those of sources are "-" (null) and ":" + source, which sort as the sources do.
TOP = ""
NODES = "tree string, level int, pos bigint, width bigint, hash string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def widths(n: int) -> list[int]:
    """Numbers of nodes by level, from n leaves to one root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def missing(n: int, known: set[int]) -> list[tuple[int, int]]:
    """Least set of (level, place) that proofs of the leaves ``known`` of n need beside what these leaves derive."""
    out = []
    for level, width in enumerate(widths(n)[:-1]):
        runs = {i // ARITY for i in known}
        out += sorted((level, j) for r in runs for j in range(ARITY * r, min(ARITY * r + ARITY, width)) if j not in known)
        known = runs
    return out


def derive(n: int, nodes: dict[tuple[int, int], str]) -> None:
    """Adds every interior node whose children are all known to ``nodes``."""
    for level, width in enumerate(widths(n)[:-1]):
        for r in {i // ARITY for at, i in nodes if at == level}:
            run = [nodes.get((level, j)) for j in range(ARITY * r, min(ARITY * r + ARITY, width))]
            if None not in run:
                nodes[level + 1, r] = sha("".join(run))


def sides(n: int, nodes: dict[tuple[int, int], str], place: int, level: int = 0) -> list[tuple[list[str], list[str]]]:
    """For each level from ``level`` on, the siblings left and right of the path from ``place``."""
    out = []
    for at, width in list(enumerate(widths(n)))[level:-1]:
        first = place - place % ARITY
        out.append(([nodes[at, j] for j in range(first, place)], [nodes[at, j] for j in range(place + 1, min(first + ARITY, width))]))
        place //= ARITY
    return out


def folded(leaf: str, path: list[tuple[list[str], list[str]]]) -> str:
    for left, right in path:
        leaf = sha("".join([*left, leaf, *right]))
    return leaf


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
           tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(doc_id, tree, leaf, tested): ``tested`` is the leaf to verify, made from ``tampered`` fields where ``when`` holds."""
    def leaf(of):
        return F.sha2(F.concat(*(_field(of(f)) for f in fields)), 256)

    source = F.col(source_col).cast("string")
    tested = leaf(lambda f: (tampered or {}).get(f, F.col(f)))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.concat(F.lit(":"), source), F.lit("-")).alias("tree"), leaf(F.col).alias("leaf"),
                       (F.when(when, tested) if when is not None and tampered else F.lit(None).cast("string")).alias("tested"))


def _fold(level: int, levels: int, low: bool):
    """Nodes of one block of a level's nodes: all levels above, or only the last; ``low`` adds the block's own nodes."""
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("pos")
        tree, row = t["tree"][0].as_py(), t["hash"].to_pylist()
        width, first = t["width"][0].as_py(), t["pos"][0].as_py()
        out = [(tree, level, first + i, width, h) for i, h in enumerate(row)] if low and not level or width == 1 else []
        for up in range(1, levels + 1):
            if width == 1:
                break
            row, width, first = [sha("".join(row[i:i + ARITY])) for i in range(0, len(row), ARITY)], -(-width // ARITY), first // ARITY
            if level or low or up == levels or width == 1:
                out += [(tree, level + up, first + i, width, h) for i, h in enumerate(row)]
        return _table(out, _NODES)
    return run


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


_NODES = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("width", pa.int64()), ("hash", pa.string())])


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / ARITY ** levels).alias("block")


def grow(level0: DataFrame, levels: int = LEVELS, low: bool = False) -> DataFrame:
    """Nodes of the trees over (tree, pos, width, hash): levels of whole blocks and all above them; with ``low`` every level."""
    parts, level, at = [], 0, level0
    while True:
        part = stage_narrow(at.groupBy("tree", _block(levels)).applyInArrow(_fold(level, levels, low), NODES), "nodes")
        parts.append(part)
        level += levels
        at = part.where((F.col("level") == level) & (F.col("width") > 1)).select("tree", "pos", "width", "hash")
        if at.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Manifest:
    """Numbered leaves, the nodes above their blocks, and the tree over the sources' roots, all staged."""

    def __init__(self, found: DataFrame, levels: int = LEVELS):
        self.levels = levels
        self.leaves = stage(numbered(found, ["tree"], [F.asc_nulls_first("doc_id"), "leaf"], "pos", "width"), "leaves")
        own = grow(self.leaves.select("tree", "pos", "width", F.col("leaf").alias("hash")), levels)
        roots = own.where("width = 1").select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "hash")
        self.roots = stage_narrow(numbered(roots, ["tree"], ["of"], "pos", "width"), "subroots")
        self.nodes = own.unionByName(grow(self.roots.select("tree", "pos", "width", "hash"), levels, low=True))

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return self.nodes.where((F.col("tree") == TOP) & (F.col("width") == 1)).select(F.col("hash").alias("root"))


def _coordinates(batches, size: int):
    for b in batches:
        out = []
        for tree, block, width, top, tops in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "width", "top", "tops"))):
            leaves = set(range(block * size, min(block * size + size, width)))
            out += [(tree, block, of, level, pos) for of, found in ((tree, missing(width, leaves)), (TOP, missing(tops, {top}))) for level, pos in found]
        yield from _table(out, _WANTED).to_batches()


_WANTED = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("of", pa.string()), ("level", pa.int32()), ("pos", pa.int64())])


def fetched(m: Manifest) -> DataFrame:
    """(tree, block, of, level, pos, hash, tops): the nodes that the leaf partition (tree, block) can't derive, each once.

    One row more, with level -1, has the place and hash of the tree's root in the tree over all roots, and their number.
    """
    size = ARITY ** m.levels
    parts = m.leaves.select("tree", _block(m.levels), "width").distinct()
    parts = parts.join(m.roots.select(F.col("of").alias("tree"), F.col("pos").alias("top"), F.col("width").alias("tops"), "hash"), "tree")
    wanted = stage_narrow(parts.select("tree", "block", "width", "top", "tops").mapInArrow(lambda batches: _coordinates(batches, size), "tree string, block bigint, of string, level int, pos bigint"), "coordinates")
    nodes = m.nodes.select(F.col("tree").alias("of"), "level", "pos", "hash")
    found = wanted.join(nodes, ["of", "level", "pos"]).select("tree", "block", "of", "level", "pos", "hash", F.lit(None).cast("bigint").alias("tops"))
    return found.unionByName(parts.select("tree", "block", F.lit(TOP).alias("of"), F.lit(-1).alias("level"), F.col("top").alias("pos"), "hash", "tops"))


def prove(m: Manifest, proofs: bool = True) -> DataFrame:
    """Every leaf with its proof: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]).

    ``proof`` has the siblings from the leaf upwards, each level from left to right.
    """
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if proofs else "")

    def expand(rows: pa.Table, others: pa.Table) -> pa.Table:
        t = rows.sort_by("pos")
        width = t["width"][0].as_py()
        at = list(zip(*(t[c].to_pylist() for c in ("doc_id", "leaf", "tested", "pos"))))
        nodes, above = {(0, pos): leaf for _, leaf, _, pos in at}, {}
        for of, level, pos, digest, n in zip(*(others[c].to_pylist() for c in ("of", "level", "pos", "hash", "tops"))):
            if level < 0:
                subroot, top, tops = digest, pos, n
            (above if of == TOP else nodes)[max(level, 0), pos] = digest
        derive(width, nodes)
        derive(tops, above)
        root, beyond = above[len(widths(tops)) - 1, 0], sides(tops, above, top)
        shared = {}
        out = []
        for doc, leaf, tested, pos in at:
            path = sides(width, nodes, pos, 0)[:1]
            if path:
                if pos // ARITY not in shared:
                    shared[pos // ARITY] = sides(width, nodes, pos // ARITY, 1)
                path = path + shared[pos // ARITY]
            path = path + beyond
            proof = [h for left, right in path for h in (*left, *right)]
            again = folded(leaf if tested is None else tested, path)
            out.append((doc, leaf, subroot, root, sha("".join(proof)), again, again == root, proof)[:8 if proofs else 7])
        return _table(out, target)

    target = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]
                       + ([("proof", pa.list_(pa.string()))] if proofs else []))
    return m.leaves.groupBy("tree", _block(m.levels)).cogroup(fetched(m).groupBy("tree", "block")).applyInArrow(expand, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Proofs of all documents; where the checksum of an id is even, the text to verify has lost its line feeds."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return prove(Manifest(leaves(docs, tampered={"text": F.replace("text", F.lit("\n"))}, when=even)), proofs=False)
