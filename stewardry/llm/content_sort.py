"""Exact duplicates by content sort.

Sampled splitters cut the space of normalised texts into ranges, each range is sorted
externally so that equal texts lie side by side, and neighbours are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm.frames import record, written

#: fixed values: the characters that do not count, [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"

ROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string()),
        ("place", pa.int64()), ("best_id", pa.int64()), ("best_place", pa.int64()),
        ("run_size", pa.int64()), ("edge", pa.bool_()),
    ]
)
ROW_DDL = (
    "doc_id long, n_chars long, text_sha256 string, place long, best_id long, "
    "best_place long, run_size long, edge boolean"
)


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each run of equal neighbours, with the run's size and its first row.

    Only ids and lengths of the current sort key wait for their run's end. Runs of a
    partition's first and last key are marked, since they may go on next door.
    """
    place = TaskContext.get().partitionId() << 40
    key = first_key = last = None
    run: list = []  # (ids, lengths, places) of the current text
    runs: list = []  # finished runs of the current key
    digest = ""

    def close() -> None:
        nonlocal run
        if run:
            ids = pa.concat_arrays([x[0] for x in run])
            runs.append((ids, np.concatenate([x[1] for x in run]), np.concatenate([x[2] for x in run]), digest))
            run = []

    def flush(edge: bool) -> Iterator[pa.RecordBatch]:
        for ids, lengths, places, sha in runs:
            n = len(ids)
            yield record(
                ROW, doc_id=ids, n_chars=lengths, text_sha256=pa.repeat(sha, n), place=places,
                best_id=pa.repeat(ids[0], n), best_place=np.full(n, places[0]),
                run_size=np.full(n, n), edge=np.full(n, edge),
            )
        runs.clear()

    small: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        norm, ids = batch.column("norm"), batch.column("doc_id")
        heads, codes = batch.column("head"), batch.column("code")
        lengths = batch.column("n_chars").to_numpy()
        places = place + np.arange(n)
        place += n
        same = np.zeros(n, bool)
        same_key = np.zeros(n, bool)
        if n > 1:
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            same_key[1:] = pc.and_(
                pc.equal(heads.slice(1), heads.slice(0, n - 1)),
                pc.equal(codes.slice(1), codes.slice(0, n - 1)),
            ).to_numpy(zero_copy_only=False)
        same[0] = last is not None and norm[0].as_py() == last
        same_key[0] = key is not None and (heads[0].as_py(), codes[0].as_py()) == key
        cuts = [*np.flatnonzero(~same).tolist(), n]
        if cuts[0]:
            cuts.insert(0, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if not same[a]:
                close()
                if not same_key[a]:
                    for part in flush(key == first_key):
                        small.append(part)
                        held += part.num_rows
                    key = (heads[a].as_py(), codes[a].as_py())
                    first_key = first_key or key
                digest = hashlib.sha256(norm[a].as_py().encode()).hexdigest()
            run.append((ids.slice(a, b - a), lengths[a:b], places[a:b]))
        last = norm[n - 1].as_py()
        if held > 20_000:
            yield from pa.Table.from_batches(small).combine_chunks().to_batches()
            small, held = [], 0
    close()
    small += flush(True)
    if small:
        yield from pa.Table.from_batches(small).combine_chunks().to_batches()


#: unfinished runs that are broadcast (about 150 bytes each); more are joined
OPEN_RUNS = 200_000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without blanks; null counts as empty, and all empty
    texts are one group. Of equal texts the row with the most code points stays, then the
    smallest id (null last), then any one of repeated rows. An empty table gives no rows;
    other columns are ignored.

    The splitters are sampled from a short head of the text, its hash and the id, so a
    sample row is small however long the texts are, and a text that a third of the rows
    share is spread over several ranges. Each range reports such an unfinished run; at
    most two sort keys a range have one, and their parts are added up.
    """
    norm = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.char_length(F.coalesce(text_col, F.lit(""))).cast("bigint").alias("n_chars"),
        normalized(F.col(text_col)).alias("norm"),
    )
    keyed = norm.select(
        "*", F.substring("norm", 1, 16).alias("head"), F.xxhash64("norm").alias("code")
    )
    order = ["head", "code", "norm", F.desc("n_chars"), F.asc_nulls_last("doc_id")]
    ranges = keyed.repartitionByRange("head", "code", "doc_id").sortWithinPartitions(*order)
    rows = written(ranges.mapInArrow(_runs, ROW_DDL), "sorted")
    best = F.struct(
        (-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"),
        F.col("doc_id").alias("id"), F.col("place").alias("place"),
    )
    open_runs = (
        rows.filter("edge").groupBy("text_sha256")
        .agg(F.min(best).alias("best"), F.count("*").alias("size"))
    )
    # at most two sort keys of every range: a few rows a partition
    open_runs = written(open_runs, "open")
    few = open_runs.count() <= OPEN_RUNS
    joined = rows.join(F.broadcast(open_runs) if few else open_runs, "text_sha256", "left")
    merged = F.col("size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(merged, F.col("best.id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", "run_size").alias("group_size"),
        (F.col("place") == F.when(merged, F.col("best.place")).otherwise(F.col("best_place"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    Null texts count as empty and are copies of each other. Of rows that repeat id and text
    one stays, of equal texts that of the smallest id, a null id last. An empty table stays
    empty.
    """
    sha = F.sha2(normalized(F.col("text")), 256)
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").cast("bigint").alias("id"), sha.alias("sha"),
    )
    stay = exact_groups(docs).filter("kept").select(
        F.col("doc_id").alias("keep_doc"), F.col("text_sha256").alias("keep_sha")
    )
    found = marked.join(
        stay, F.col("id").eqNullSafe(F.col("keep_doc")) & (F.col("sha") == F.col("keep_sha")), "left_semi"
    )
    # repeated rows of one id and text: one of them, the longest original
    nth = F.row_number().over(
        Window.partitionBy("id", "sha").orderBy(F.desc(F.char_length(F.coalesce("doc.text", F.lit("")))))
    )
    return found.withColumn("nth", nth).filter("nth = 1").select("doc.*")
