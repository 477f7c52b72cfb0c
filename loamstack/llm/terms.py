"""Frequencies of all terms by recursive radix partitions on disk, each aggregated by DuckDB."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.base import or_fold
from loamstack.runtime import fresh_path, remove

RADIX_BITS = 6
SPLIT_BITS = 4  #: bits by which an oversized partition is split further
PART_ROWS = 2_000_000  #: partial counts one aggregation takes at most, unless they are of a few terms
HASH_BITS = 60
ID_CELLS = 1 << 24  #: cells by which ids that may repeat are told from the others
FLUSH_ROWS = 1_000_000  #: distinct terms a map task keeps before it hands them on

_PARTIAL = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _fold(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables)
    g = t.group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
    return pa.table({"term": g["term"], "occurrences": g["occurrences_sum"], "records": g["records_sum"]}, schema=_PARTIAL)


def _count_batch(toks: pa.Array) -> pa.Table:
    """Occurrences and records of each term of a batch of token lists."""
    flat = toks.flatten()
    lengths = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(toks)), lengths)
    codes = pc.dictionary_encode(flat)
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    valid = codes.indices.is_valid().to_numpy(zero_copy_only=False)
    idx = codes.indices.fill_null(0).to_numpy(zero_copy_only=False)[valid].astype(np.int64)
    size = len(codes.dictionary)
    once = np.unique(row[valid] * max(size, 1) + idx) % max(size, 1)
    return pa.table({"term": codes.dictionary, "occurrences": np.bincount(idx, minlength=size),
                     "records": np.bincount(once, minlength=size)}, schema=_PARTIAL)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[pa.Table] = []
    rows = 0
    for b in batches:
        t = _count_batch(b.column("toks"))
        kept.append(t)
        rows += t.num_rows
        if rows > 2 * FLUSH_ROWS:
            kept = [_fold(kept)]
            rows = kept[0].num_rows
            if rows > FLUSH_ROWS:
                yield from kept[0].combine_chunks().to_batches(max_chunksize=100_000)
                kept, rows = [], 0
    if rows:
        yield from _fold(kept).combine_chunks().to_batches(max_chunksize=100_000)


def _aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of stored partitions, one partition after the other."""
    import duckdb
    import pyarrow.dataset as ds
    from pyarrow import fs

    for b in batches:
        for uri in b.column("leaf").to_pylist():
            system, path = fs.FileSystem.from_uri(uri)
            stored = ds.dataset(path, filesystem=system, format="parquet", partitioning=None)
            stream = stored.scanner(columns=["term", "occurrences", "records"], batch_size=100_000).to_reader()  # noqa: F841  (DuckDB reads it by name)
            con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
            yield from con.sql(
                "SELECT term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(records) AS BIGINT) AS records "
                "FROM stream GROUP BY term").to_arrow_reader(100_000)
            con.close()


def _once(df: DataFrame, id_col: str, toks_col: str) -> DataFrame:
    """(toks) of each record once; only records whose id may repeat are shuffled, and those by id."""
    rows = df.select(F.col(id_col).alias("id"), F.col(toks_col).alias("toks"))

    def cell(ids: pa.Array) -> np.ndarray:
        return (ids.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(40)).astype(np.int64)

    def add(arr: np.ndarray, b: pa.RecordBatch) -> None:
        cells, n = np.unique(cell(b.column("h")), return_counts=True)
        arr[cells] = np.minimum(arr[cells].astype(np.int64) + n, 2)

    several = or_fold(rows.select(F.xxhash64("id").alias("h")), ID_CELLS, "uint8", "two", add) > 1
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(several))

    def pick(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for b in batches:
                c = cell(b.column("h"))
                keep = ((bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1) == wanted
                yield b.filter(pa.array(keep))
        return run

    hashed = rows.withColumn("h", F.xxhash64("id"))
    alone = hashed.mapInArrow(pick(False), hashed.schema).select("toks")
    again = hashed.mapInArrow(pick(True), hashed.schema).groupBy("id").agg(F.first("toks", ignorenulls=True).alias("toks")).select("toks")
    return alone.unionByName(again).where(F.size("toks") > 0)


def term_frequencies(df: DataFrame, id_col: str, toks_col: str) -> DataFrame:
    """(term, occurrences, records): every distinct term of all token lists.

    Map tasks count what they hold, so that a term of a third of all rows
    leaves each task as one row; the partial counts go to disk in the shared
    folder, partitioned by the first bits of the term's hash.  Partitions of
    more than PART_ROWS rows are written again by further bits, and so on,
    until each fits or only a few terms are left in it; then every partition
    is read where it lies and aggregated by DuckDB on its own, without
    another shuffle.  The driver sees one row for each partition.

    A record delivered twice (same id) counts once, by its first non-null
    list.  Null lists and null terms count nothing, the empty term is a term;
    terms are compared as stored.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    part = _once(df, id_col, toks_col).mapInArrow(_partial, "term string, occurrences long, records long")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bits = max(RADIX_BITS, (n - 1).bit_length())
    rows, leaves, emptied = part.withColumn("h", F.xxhash64("term")), [], []
    while True:
        path = fresh_path(spark, "terms")
        (rows.withColumn("radix", F.shiftrightunsigned("h", 64 - bits)).repartition(n, "radix")
         .write.partitionBy("radix").parquet(path))
        stored = spark.read.schema("term string, occurrences long, records long, h long, radix long").parquet(path)
        for folder in emptied:
            remove(spark, folder)
        sizes = stored.groupBy("radix").count().collect()
        large = {r.radix for r in sizes if r["count"] > PART_ROWS} if bits + SPLIT_BITS <= HASH_BITS else set()
        leaves += [f"{path}/radix={r.radix}" for r in sizes if r.radix not in large]
        if not large:
            break
        emptied = [f"{path}/radix={r}" for r in large]
        rows = spark.read.schema("term string, occurrences long, records long, h long").parquet(*emptied)
        bits += SPLIT_BITS
    if not leaves:
        return part.where("false")
    return spark.createDataFrame([(x,) for x in leaves], "leaf string").repartition(min(len(leaves), 4 * n)).mapInArrow(
        _aggregate, "term string, occurrences long, records long")


def mark_terms(terms: DataFrame, total: int, rare: int = 3, common_percent: int = 2) -> DataFrame:
    """Adds mark: rare below ``rare`` records, common above ``common_percent`` % of ``total``, else null.

    A term that is both (very few records in all) is rare.
    """
    return terms.withColumn("mark", F.when(F.col("records") < rare, "rare").when(
        F.col("records") * 100 > F.lit(common_percent) * F.lit(total), "common"))


def count_records(df: DataFrame, id_col: str) -> int:
    return df.select(id_col).distinct().count()
