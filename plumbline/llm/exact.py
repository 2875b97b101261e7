"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text without white space is cut where its own content says so: behind the first sentence
of a certain ending after ``LEAST`` characters, or after ``MOST``.  Each distinct chunk gets an identifier that is
verified against the chunk's characters, and texts are equal when their ordered identifier lists
are.  Only distinct chunks are shuffled with their characters, once, after map-side
deduplication; documents move as lists of 8 bytes a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Tables

LEAST, MOST = 64, 2048
# about one sentence end in four is a cut, so that texts fall into step again after a difference
CUT = r"(?s).{%d,%d}?(?:(?<=[dhms37][.!?])|(?<=[。！？]))|.{1,%d}" % (LEAST, MOST, MOST)


def squeezed(text: Column) -> Column:
    """The text without blanks, tabs, line ends and form feeds; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hash_bits: int = 64
) -> DataFrame:
    """Group of every row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deleting white space.  The row with the longest original
    text, then the smallest id, stays.  Null counts as an empty text, and all empty texts are one
    group.  Rows with a repeated id are told apart only by their text; a null id stays null and
    loses against any other id.  Other columns are ignored, whatever their names; an empty table
    gives an empty result.  ``hash_bits`` narrows the chunk hash, for tests of its collisions.
    """
    tables = Tables(docs.sparkSession)
    rows = _rows(tables, docs, id_column, text_column, hash_bits)
    best = F.max_by(F.col("id"), F.struct("n", F.col("id").isNotNull(), F.bitwise_not("id")))
    groups = rows.groupBy("list", "recipe").agg(best.alias("keep_id"), F.count("*").alias("size"))
    groups = tables.store(groups)  # so that both sides are shuffled and a hot group can be split
    out = rows.join(groups, ["list", "recipe"])
    return out.select(
        F.col("id").alias(id_column),
        "keep_id",
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _own(text: Column) -> Column:
    """Digest of the text as it is, white space included; of null the empty string."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))


def _rows(
    tables: Tables, docs: DataFrame, id_column: str, text_column: str, hash_bits: int = 64, own: bool = False
) -> DataFrame:
    """id, length, digest, recipe and its hash ``list`` of every row, with ``own`` also ``_own``."""
    name = F.xxhash64 if hash_bits >= 64 else lambda c: F.xxhash64(c) % (1 << hash_bits)
    text = squeezed(F.col(text_column))
    source = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.length(text_column), F.lit(0)).alias("n"),
        text.alias("squeezed"), *([_own(F.col(text_column)).alias("own")] if own else []),
    )

    # distinct chunks, compared by content; a hash that names two of them is a collision
    parts = source.select(F.explode(chunks("squeezed")).alias("chunk"))
    distinct = parts.groupBy(name(F.col("chunk")).alias("hash"), "chunk").agg(F.lit(1).alias("one"))
    clash = tables.store(distinct.groupBy("hash").count().where("count > 1").select("hash"))
    recipe = F.transform(chunks("squeezed"), lambda c: F.struct(name(c).alias("h"), F.lit(0).alias("k")))
    digest = F.sha2(F.col("squeezed").cast("binary"), 256)
    kept = ["id", "n", "own"] if own else ["id", "n"]
    rows = source.select(*kept, digest.alias("text_sha256"), recipe.alias("recipe"))
    if not clash.isEmpty():
        rows = _resolved(tables, source, distinct, clash, rows, name)
    return tables.store(rows.withColumn("list", F.xxhash64("recipe")))


def _resolved(tables, source, distinct, clash, rows, name):
    """Recipes in which chunks with a clashing hash get a number that tells them apart.

    The numbered chunks are those of clashing hashes alone; their positions are found by the hash
    first, so only those chunks are moved again.
    """
    told = distinct.join(clash, "hash", "left_semi").select("hash", "chunk")
    below = told.alias("x").join(told.alias("y"), F.expr("x.hash = y.hash and y.chunk < x.chunk"), "left")
    told = below.groupBy("x.hash", "x.chunk").agg(F.count("y.chunk").cast("int").alias("k"))
    placed = source.select("id", F.sha2(F.col("squeezed").cast("binary"), 256).alias("text_sha256"),
                           F.posexplode(chunks("squeezed")).alias("pos", "chunk"))
    placed = placed.withColumn("hash", name(F.col("chunk"))).join(clash, "hash", "left_semi")
    found = placed.join(told, ["hash", "chunk"]).where("k > 0")
    marks = found.groupBy("id", "text_sha256").agg(
        F.map_from_entries(F.collect_set(F.struct("pos", "k"))).alias("marks")
    )
    joined = rows.alias("r").join(
        marks.alias("m"),
        F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.text_sha256") == F.col("m.text_sha256")),
        "left",
    )
    number = lambda c, i: F.struct(
        c["h"].alias("h"),
        F.coalesce(F.try_element_at(F.col("m.marks"), i), F.lit(0)).alias("k"),
    )
    same = [F.col(f"r.{c}") for c in rows.columns if c != "recipe"]
    return joined.select(*same, F.transform("recipe", number).alias("recipe"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row of every group of equal texts, with its columns.

    The row is the one that ``exact_groups`` prefers, also if its id is null or repeated; among rows
    of that id and length the one whose text has the largest digest, null after any text.  Of rows
    that agree in id and text an arbitrary one stays.
    """
    tables = Tables(docs.sparkSession)
    rows = _rows(tables, docs, "doc_id", "text", own=True)
    copies = rows.groupBy("list", "recipe", "id", "n", "own").agg(F.count("*").alias("copies"))
    order = F.struct("n", F.col("id").isNotNull(), F.bitwise_not("id"), "own")
    best = copies.groupBy("list", "recipe").agg(F.max_by(F.struct("id", "own", "copies"), order).alias("b"))
    best = tables.store(best.select("b.*"), (F.col("copies") > 1).cast("long"))
    tables.drop(rows)

    def stay(of: DataFrame) -> DataFrame:
        same = (F.col("d.__own") == F.col("s.own")) & F.col("d.doc_id").eqNullSafe(F.col("s.id"))
        marked = docs.withColumn("__own", _own(F.col("text")))
        return marked.alias("d").join(of.alias("s"), same, "left_semi")

    out = stay(best.where("copies = 1"))
    if best._sum:  # rows that agree in id and text
        out = out.unionAll(stay(best.where("copies > 1")).dropDuplicates(["doc_id", "__own"]))
    return out.drop("__own")
