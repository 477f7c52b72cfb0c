"""Near-duplicate pairs, their classes and groups, and the survivors of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.groupmatrix import keyed_sets, near_links
from loamstack.operators.components import connected_components


def classes(sets: DataFrame) -> DataFrame:
    """(g, f, id), each id once: which rows hold which token set."""
    return sets.select("g", "f", "id").repartition("g", "f").dropDuplicates(["g", "f", "id"])


def near_pairs(df: DataFrame, id_col: str, toks_col: str, scope_col: str | None = None,
               num: int = 3, den: int = 4) -> DataFrame:
    """(a, b), a < b: all pairs of ids whose token sets have Jaccard >= num/den.

    Links are found between distinct sets and only at the end spread over the
    ids that hold them, as many rows as the result has.  Rows delivered twice
    (same id) count once; null, empty or missing tokens are near to nothing,
    and with ``scope_col`` only ids of one non-null scope are compared.
    Columns of ``df`` beside the named ones are not read.
    """
    sets = keyed_sets(df.select(id_col, toks_col, *([scope_col] if scope_col else [])), id_col, toks_col, scope_col)
    links = near_links(sets.select("hs", "f", "g"), num, den)
    held = classes(sets)
    several = held.groupBy("g", "f").count().where("count > 1")
    links = links.unionByName(several.select(
        F.col("g").alias("ag"), F.col("f").alias("af"), F.col("g").alias("bg"), F.col("f").alias("bf")))
    left = held.select(F.col("g").alias("ag"), F.col("f").alias("af"), F.col("id").alias("x"))
    right = held.select(F.col("g").alias("bg"), F.col("f").alias("bf"), F.col("id").alias("y"))
    return (
        links.join(left, ["ag", "af"]).join(right, ["bg", "bf"])
        .where("x <> y and (ag <> bg or af <> bf or x < y)")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )


def near_groups(df: DataFrame, id_col: str, toks_col: str, scope_col: str | None = None,
                num: int = 3, den: int = 4) -> DataFrame:
    """(id, root, links) for every row that is near to another.

    root is the smallest id of the group the near links form, directly or
    through others; links counts the near sets different from the row's own.
    Copies are never expanded into pairs.  Nulls and empties as in near_pairs.
    """
    sets = keyed_sets(df.select(id_col, toks_col, *([scope_col] if scope_col else [])), id_col, toks_col, scope_col)
    links = near_links(sets.select("hs", "f", "g"), num, den)
    held = classes(sets)
    heads = held.groupBy("g", "f").agg(F.min("id").alias("head"), F.count("*").alias("n"))
    a = heads.select(F.col("g").alias("ag"), F.col("f").alias("af"), F.col("head").alias("a"))
    b = heads.select(F.col("g").alias("bg"), F.col("f").alias("bf"), F.col("head").alias("b"))
    from loamstack.runtime import cut

    edges = cut(links.join(a, ["ag", "af"]).join(b, ["bg", "bf"]).select("a", "b"))
    roots = connected_components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("head")).groupBy("head").agg(F.count("*").alias("links"))
    found = (
        heads.join(roots.withColumnRenamed("node", "head"), "head", "left").join(degree, "head", "left")
        .where("n > 1 or root is not null")
        .select("g", "f", F.coalesce("root", "head").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    return held.join(found, ["g", "f"]).select("id", "root", "links")


def survivors(df: DataFrame, group_cols: list[str], attributes: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """One row per group, each attribute taken from its best row.

    ``attributes`` maps an output column to (value column, ranking columns,
    the most important first: source priority, timestamp or position, ...).
    All attributes come from a single aggregation: the maximum of the struct
    (value is not null, rankings ..., value).  Maxima combine on the map side,
    so a group of a third of all rows is no different from any other.  A null
    ranking is below every other one; ties go to the larger value; an
    attribute that is null in every row stays null; null group keys form a
    group of their own.
    """
    best = [
        F.max(F.struct(F.col(v).isNotNull().alias("has"), *[F.col(r).alias(f"r{k}") for k, r in enumerate(ranks)],
                       F.col(v).alias("value"))).alias(f"__{name}")
        for name, (v, ranks) in attributes.items()
    ]
    out = df.groupBy(*group_cols).agg(*best)
    return out.select(*group_cols, *[F.col(f"__{name}.value").alias(name) for name in attributes])


def entry_groups(entries: DataFrame, actions: DataFrame) -> DataFrame:
    """Entries of near groups within one file, with what ranks them.

    (root, entry_id, file_id, pos, text, length, trust, result): trust is the
    highest seq of an action of the file whose result is the entry's text,
    character for character, and null if there is none.  Headers are left
    out, entries delivered twice count once, actions without a result or seq
    are no source.
    """
    body = entries.where("not coalesce(is_header, false)")
    groups = near_groups(body, "entry_id", "toks", "file_id").select(F.col("id").alias("entry_id"), "root")
    rows = (
        body.select("entry_id", "file_id", "pos", "text")
        .join(groups, "entry_id").dropDuplicates(["entry_id"])
        .withColumn("length", F.length("text"))
        .withColumn("t0", F.xxhash64(F.lit(3), "text")).withColumn("t1", F.xxhash64(F.lit(5), "text"))
    )
    said = (
        actions.where("result is not null and seq is not null and file_id is not null")
        .groupBy("file_id", F.xxhash64(F.lit(3), "result").alias("t0"), F.xxhash64(F.lit(5), "result").alias("t1"))
        .agg(F.max("seq").alias("trust"))
    )
    return rows.join(said, ["file_id", "t0", "t1"], "left").drop("t0", "t1")
