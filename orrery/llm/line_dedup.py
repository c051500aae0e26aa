"""Line dedup, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, documents, fresh, lower_ascii

#: A line that more than 1 in HOT rows have is broadcast.
HOT = 1024


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    """Identity of a key: 64 + 32 bits of two hash families and the key's length."""
    return F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"), F.octet_length(key).alias("n"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """Drop lines whose key occurs in ``min_docs`` documents or more, but for the
    smallest id holding it; the other lines are joined again in their order.

    Returns every row and column of ``docs`` with ``text_col`` replaced and
    ``n_lines`` and ``n_dropped`` (long) added; columns of those names are
    overwritten, all others stay, whatever they are called.

    A line is normalised (white space stripped, A-Z lowered), keys shorter than
    ``min_chars`` code points never count.  Null and empty texts are one empty
    line.  Rows with a null id keep all their lines and do not count as documents;
    rows with the same id are one document.  An empty table gives an empty table.

    Only (hash, document, row, places) are exploded and shuffled, a line once a row; counts have
    map-side partial sums.  Lines of more than 1 in HOT of all rows, HOT lines at most, are
    broadcast, so that no task gets all documents of one; the others are joined by hash.
    Places to drop come back to their row as one sorted array, which masks the split text.
    """
    row, gone = fresh(docs, "row"), fresh(docs, "gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    name = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"))  # rows of one id and text are alike
    held = (
        docs.where(F.col(id_col).isNotNull())
        .select(name.alias("row"), F.posexplode(lines).alias("at", "line"))
        .select("row", "at", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("row", "at", key_hash(F.col("key")).alias("h"))
        .groupBy("row", "h").agg(F.collect_set("at").alias("at"))
    )
    # reads "at", so that both uses of held are one shuffle
    number = F.sum(F.when(F.size("at") > 0, 1)) if min_docs <= 2 else F.count_distinct(F.when(F.size("at") > 0, F.col("row.id")))
    counted = held.groupBy("h").agg(number.alias("n"), F.min("row.id").alias("first"), F.max("row.id").alias("last"))
    frequent = counted.where((F.col("first") < F.col("last")) & (F.col("n") >= min_docs) if min_docs >= 2 else F.lit(True))
    rows = counted.agg(F.sum("n")).scalar()
    hot = frequent.where(F.col("n") * HOT > rows).select(F.col("h").alias("hot"), F.col("first").alias("hot_first"))
    dealt = F.when(F.col("hot_first").isNull(), F.col("h")).otherwise(F.struct(F.xxhash64("row").alias("a"), F.lit(0).alias("b"), F.lit(-1).alias("n")))
    marked = held.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left").select("row", "at", "hot_first", dealt.alias("h"))
    doomed = (
        marked.join(frequent.select("h", "first"), "h", "left")
        .where(F.col("row.id") != F.coalesce("hot_first", "first"))
        .groupBy("row")
        .agg(F.array_sort(F.flatten(F.collect_list("at"))).alias(gone))
        .withColumnRenamed("row", row)
    )
    places = F.col(gone)
    masked = F.flatten(F.transform(places, lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    kept = F.array_compact(F.zip_with(lines, masked, lambda line, drop: F.when(~F.coalesce(drop, F.lit(False)), line)))
    out = docs.join(doomed, name == F.col(row), "left")
    columns = {
        text_col: F.when(places.isNull(), text).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size(F.when(places.isNotNull(), places)), F.lit(0)).cast("long"),
    }
    return out.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND k.doc_id <> f.first_doc) AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
