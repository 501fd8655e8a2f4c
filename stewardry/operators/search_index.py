"""Substring search by an index of trigrams in files.

A text that contains a query contains its trigrams. The index files the ids of the rows that
hold a trigram in chunks of bounded size, in folders by a hash of the trigram, next to the
searched columns, in folders by a hash of the id. A query reads the folders of its rarest
trigrams, intersects them, and verifies the rows that are left. Queries of fewer than three
characters scan the stored rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grams, matches_any
from ..session import scratch_path

GRAM = 3


def folder_of(value: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(folders)).cast("int")


def trigram_postings(chunk: int, most_bytes: int = 1 << 20) -> Callable:
    """For ``mapInArrow`` over an id and binary texts: ``gram, uses, ids``, for each trigram the ids
    of the rows at hand that hold it, ``chunk`` at most in a row.

    Pairs of row and trigram are met where the row is, as numbers, and never leave the task; rows
    are taken ``most_bytes`` of text at a time, a longer text by itself. The function is local
    so that it travels to the workers by value.
    """

    def postings(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def slices(batch):
            sizes = np.zeros(len(batch), "int64")
            for column in batch.columns[1:]:
                sizes += np.fromiter((len(v) if v else 0 for v in column.to_pylist()), "int64", len(batch))
            group = np.cumsum(sizes) // most_bytes
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
            return [batch.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]

        def pairs(rows):
            """Trigrams as three code points of 21 bits, and the numbers of the rows they are in."""
            for column in rows.columns[1:]:
                texts = [v.decode("utf-8", "replace") if v else "" for v in column.to_pylist()]
                points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype("int64")
                row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), "int64", len(texts)))
                whole = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else row[:0]
                yield points[whole] << 42 | points[whole + 1] << 21 | points[whole + 2] if len(whole) else whole, row[whole]

        for rows in (part for batch in batches for part in slices(batch)):
            codes, row = (np.concatenate(c) for c in zip(*pairs(rows), strict=True))
            if not len(codes):
                continue
            grams, nth = np.unique(codes, return_inverse=True)
            held = np.unique(nth * len(rows) + row)
            nth, row = held // len(rows), held % len(rows)
            first = np.flatnonzero(np.diff(nth, prepend=-1))
            place = np.arange(len(nth)) - first[nth]
            starts = np.flatnonzero(place % chunk == 0)
            points = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], 1).astype("<u4")
            text = points.tobytes().decode("utf-32-le")
            names = pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())
            offsets = np.append(starts, len(nth))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows.column(0).cast(pa.string()).take(pa.array(row)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(nth[starts])), pa.array(np.diff(offsets), pa.int64()), ids], ["gram", "uses", "ids"])

    return postings


class SearchIndex:
    """Index of ``columns`` of a table with unique ``key``; see :meth:`search`."""

    #: ids that travel together, folders of postings and of rows
    CHUNK = 4096
    FOLDERS = 64
    #: a query's trigrams that are intersected, from the rarest on
    GRAMS = 3

    def __init__(self, df: DataFrame, columns: list[str], key: str = "id", path: str | None = None):
        self.spark, self.columns, self.key = df.sparkSession, columns, key
        root = path or scratch_path(self.spark, "search")
        stored = df.select(F.col(key).cast("string").alias(key), *columns)
        placed = stored.withColumn("folder", folder_of(F.col(key), self.FOLDERS))
        placed.hint("rebalance", "folder").write.partitionBy("folder").parquet(f"{root}/rows")
        self.rows = self.spark.read.schema(placed.schema).parquet(f"{root}/rows")
        # lower case as the queries have it; bytes, since a text need not be valid UTF-8
        texts = self.rows.select(F.col(key).alias("row"), *[F.lower(F.col(c)).cast("binary").alias(f"text{i}") for i, c in enumerate(columns)])
        posted = texts.mapInArrow(trigram_postings(self.CHUNK), "gram string, uses long, ids array<string>")
        posted = posted.withColumn("folder", folder_of(F.col("gram"), self.FOLDERS)).hint("rebalance", "folder")
        posted.sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{root}/postings")
        self.postings = self.spark.read.schema("gram string, uses long, ids array<string>, folder int").parquet(f"{root}/postings")

    def _grams(self, query: str) -> list[tuple[str, int]]:
        """The query's trigrams with their folders."""
        low = F.lower(F.lit(query))
        each = self.spark.range(1).select(F.explode(grams(low, GRAM)).alias("gram"))
        return [(r.gram, r.folder) for r in each.select("gram", folder_of(F.col("gram"), self.FOLDERS).alias("folder")).collect()]

    def candidates(self, query: str) -> DataFrame | None:
        """``row``: ids of the rows that hold the query's rarest trigrams; None if it has none."""
        wanted = self._grams(query)
        if not wanted:
            return None
        own = self.postings.filter(
            F.col("folder").isin([f for _, f in wanted]) & F.col("gram").isin([g for g, _ in wanted])
        )
        uses = {r.gram: r.uses for r in own.groupBy("gram").agg(F.sum("uses").alias("uses")).collect()}  # the query's trigrams
        if len(uses) < len(wanted):
            return own.select(F.explode("ids").alias("row")).limit(0)
        rare = sorted(wanted, key=lambda w: (uses[w[0]], w[0]))[: self.GRAMS]
        found = None
        for gram, folder in rare:
            ids = self.postings.filter((F.col("folder") == folder) & (F.col("gram") == gram)).select(F.explode("ids").alias("row"))
            found = ids if found is None else found.join(ids, "row", "left_semi")
        return found

    def search(self, query: str) -> DataFrame:
        """``key`` and ``columns`` of the rows one of whose columns contains ``query``, case
        ignored and wildcards literal; a null column matches nothing."""
        match = matches_any(query, self.columns)
        found = self.candidates(query)
        if found is None:
            return self.rows.filter(match).drop("folder")
        found = found.withColumn("folder", folder_of(F.col("row"), self.FOLDERS))
        folders = [r.folder for r in found.select("folder").distinct().collect()]  # FOLDERS at most
        own = self.rows.filter(F.col("folder").isin(folders) & match)
        same = (own[self.key] == found["row"]) & (own["folder"] == found["folder"])
        return own.join(found, same, "left_semi").drop("folder")
