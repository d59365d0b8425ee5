"""Line dedup: lines that many documents share go from all but one of them.

Lines are exploded, normalised and hashed to 128 bits; documents are counted per
hash; the lines over the threshold are joined back, and texts are reassembled by
position without them.  Only hashes and positions are shuffled until the texts
meet the list of positions to drop.

Documents of a line are made distinct by line and document, then counted, combined
on the map side, so a line that a third of all documents hold is spread over all
tasks.  The join back has that line's rows on one side and a single row of a
written table on the other: Spark broadcasts that table where its size allows it,
and adaptive execution splits the hot line otherwise.

Defined results: NULL and empty texts are one empty line.  A row whose id is
NULL is counted as no document and never owns a line.  Rows that repeat an id
count as one document; what goes from one of them goes from every row with that
id that holds it.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import SPACE, ascii_lower, filled, key_pair, materialize


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Replace ``text_col`` and add ``n_lines`` (before) and ``n_dropped``.

    A line goes if its key has ``min_chars`` or more code points and is found in
    ``min_docs`` or more documents, except in the largest id that holds it.
    """
    passed = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in passed]).alias("d"),
        docs[id_col].alias("id"),
        filled(docs[text_col]).alias("t"),
        F.xxhash64(filled(docs[text_col])).alias("k"),
    )
    exploded = rows.select("id", "k", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    trimmed = exploded.select("id", "k", "pos", F.trim("line", F.lit(SPACE)).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = key_pair(ascii_lower(F.col("key")))
    lines = trimmed.select("id", "k", "pos", h1.alias("h1"), h2.alias("h2"))
    # Distinct documents are counted per line and document first, so a hot line is no hot task.
    common = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("owner"))
    common = materialize(common.where(F.col("n") >= min_docs).drop("n"), "common-lines")
    gone = lines.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("owner")))
    drops = gone.groupBy(F.col("id").alias("i2"), F.col("k").alias("k2")).agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    met = rows.join(drops, rows["id"].eqNullSafe(drops["i2"]) & (rows["k"] == drops["k2"]), "left")
    split = met.select("d", "t", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"), F.split("t", "\n").alias("lines"))
    # Slices between one dropped position and the next: linear, however many go.
    pieces = F.zip_with(
        F.concat(F.array(F.lit(-1)), "drop"),
        F.concat("drop", F.array(F.size("lines"))),
        lambda a, b: F.slice("lines", a + 2, b - a - 1),
    )
    left = F.when(F.size("drop") == 0, F.col("t")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    result = split.select(
        "d", left.alias("left"), F.size("lines").cast("bigint").alias("n_lines"), F.size("drop").cast("bigint").alias("n_dropped")
    )
    columns = [F.col("left").alias(c) if c == text_col else F.col(f"d.`{c}`") for c in passed]
    return result.select(*columns, "n_lines", "n_dropped")


# --- the query and its twin -------------------------------------------------------------------------------------------


def digest(docs: DataFrame) -> DataFrame:
    out = drop_common_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.owner AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
