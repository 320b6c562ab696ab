"""Line de-duplication: lines that several documents share stay only in the first of them."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.workspace import write_through
from .frames import SPACES, ascii_lower, digest, named, packed, unpacked
from .hot_keys import attach


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points.

    Columns: id, t1 and t2 (digest of the whole text), pos, h1 and h2 (digest of the key).
    """
    text = F.coalesce(named(text_col), F.lit(""))
    t1, t2 = digest(F.col("text"))
    h1, h2 = digest(F.col("key"))
    docs = docs.select(named(id_col).alias("id"), text.alias("text")).filter("id IS NOT NULL")
    lines = docs.select("id", t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACES))))
    return keys.filter(F.length("key") >= min_chars).select("id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))


def shared_keys(keys: DataFrame, min_docs: int = 2) -> DataFrame:
    """Keys that at least ``min_docs`` different documents hold, with the smallest id among these and the number of lines.

    Copies within a document and then within a task are merged before the key is
    shuffled, so a line that a third of all documents hold arrives as a few rows.
    """
    held = keys.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("lines"))
    counted = held.groupBy("h1", "h2").agg(
        F.count("id").alias("n_docs"), F.min("id").alias("keeper"), F.sum("lines").alias("lines"))
    return counted.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper", "lines")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2,
) -> DataFrame:
    """``docs`` with the text's shared lines dropped, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without white space at both ends and with A-Z in
    lower case.  Keys of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold lose all their lines except in the document with
    the smallest id.  The rest is joined again by position.

    A null text is an empty one, which has one empty line.  Documents without an
    id are neither counted nor changed.  Rows with equal ids are one document
    when counting; each of them keeps its own text.  An empty table gives an
    empty one.  Input columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    keys = write_through(line_keys(docs, id_col, text_col, min_chars), "line_keys")
    shared = write_through(shared_keys(keys, min_docs), "shared_keys")
    dropped = attach(keys, shared, ["h1", "h2"], "lines", keys.count(), "inner").filter("id <> keeper")
    dropped = dropped.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("dropped"))

    text = F.coalesce(named(text_col), F.lit(""))
    t1, t2 = digest(text)
    rows = packed(docs, r_id=named(id_col), r_t1=t1, r_t2=t2)
    same = (F.col("r_id") == F.col("id")) & (F.col("r_t1") == F.col("t1")) & (F.col("r_t2") == F.col("t2"))
    joined = rows.join(dropped, same, "left")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    # The lines are passed into the function as an array of one, so that they are split once per document.
    rest = F.transform(F.array(lines), lambda whole: F.array_join(F.transform(kept, lambda i: F.get(whole, i)), "\n"))
    new = F.when(F.col("dropped").isNull(), text).otherwise(F.element_at(rest, 1))
    out = joined.select(
        "row", new.alias("new_text"), F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    out = out.withColumn("row", F.col("row").withField("`" + text_col + "`", F.col("new_text")))
    return unpacked(out, docs.columns, n_lines=F.col("n_lines"), n_dropped=F.col("n_dropped"))
