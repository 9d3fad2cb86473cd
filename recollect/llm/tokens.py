"""Token counts by heap-and-linked-list byte-pair merging: initial symbols minus merges, without any ids.

Each text is cut into pieces, and each piece's count is computed once per worker while it stays in a bounded table. A
piece is never cut, so counts equal the library's for texts of any length.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count one token each;
repeated rows and ids are counted row by row; other columns are ignored; an empty table gives an empty result.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recollect.llm.bpe import KEPT_PIECES, Cutter, Merges, merged, worker_table
from recollect.llm.frames import arrow_map

LIMIT = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_piece(piece: str, ranks: dict) -> int:
    data = piece.encode("utf-8", "replace")
    return len(data) - merged(data, ranks)[1]


def count_text(text: str, cutter: Cutter, ranks: dict, table: dict) -> int:
    total = 0
    for run, special in cutter.runs(text):
        total += special is not None
        pieces = cutter.pieces(run)
        for p in set(pieces).difference(table):
            if len(table) >= KEPT_PIECES:
                table.clear()
                for q in set(pieces):
                    table[q] = count_piece(q, ranks)
                break
            table[p] = count_piece(p, ranks)
        total += sum(map(table.__getitem__, pieces))
    return total


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    path = vocabulary or default_vocabulary()
    merges = Merges(path)
    shared = docs.sparkSession.sparkContext.broadcast((merges.ranks, list(merges.special)))

    def step(batch: pa.RecordBatch) -> dict:
        ranks, special = shared.value
        cutter, table = Cutter(special), worker_table(f"counts {path}")
        n_bytes, n_tokens = [], []
        for data in batch.column(1).to_pylist():
            text = (data or b"").decode("utf-8", "replace")
            n_bytes.append(len(data or b""))
            n_tokens.append(count_text(text, cutter, ranks, table))
        return {"doc_id": batch.column(0), "n_bytes": n_bytes, "n_tokens": n_tokens}

    data = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return arrow_map(data, step, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def digest(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The columns of query op3."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
