"""Filter interaction audit by a Gray-code walk over the sets of filters.

Every document gets a mask of the filters it fails.  All that a sequence of
filters does to a group of documents follows from how many of them have each
mask.  So documents are counted by part and mask, and for each part the sets of
filters are walked in Gray order: each step toggles one filter.  A mask cell
counts how many of the active filters it fails; when the count leaves zero its
documents leave the survivors, when it comes back to zero they return.  The
survivors of all sets are stored, and each step of each order is the difference
of two of them.

The text is read once, for the mask and a hash that stands for it; what is
shuffled after that is some sixty bytes a document.  A text that a third of all
documents share is one row per task before its smallest id is known, and the
join with it splits such a key.

Defined results: NULL text and NULL part count as empty.  A NULL id is not
larger than any other, so it never fails the filter for copies; rows that repeat
the smallest id of a text don't either.  A document is good or toxic if any of
its label rows says so.  Texts of any length are judged whole.  An empty table
gives no parts and no rows; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from pairloom.llm.common import UPPER, filled, materialize, words

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 2
MARKS = "[#$%&*|]"
COUNTS = ("n", "good", "toxic")
RESULTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """The conditions that need nothing but the text: filters A to D."""
    listed = words(text)
    uppers = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [
        F.size(listed) < MIN_WORDS,
        100 * F.size(F.array_distinct(listed)) < DISTINCT_PERCENT * F.size(listed),
        100 * uppers.cast("long") > UPPER_PERCENT * F.length(text),
        text.rlike(MARKS),
    ]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, mask`` of each row; bit *i* of the mask is set if filter *i* fails."""
    text = filled(docs[text_col])
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_failures(text))]
    rows = docs.select(
        docs[id_col].alias("id"), filled(docs[part_col].cast("string")).alias("part"),
        sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2(text, 256)).alias("sha"),
    )
    rows = materialize(rows, "failures")
    groups = rows.groupBy("sha").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # Written first: a join of two plain tables can split a text that a third of all rows share.
    least = materialize(groups.where("copies > 1").select("sha", "least"), "least-ids")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return rows.join(least, "sha", "left").select("id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """Per part: the number of documents of each mask, and of the good and toxic ones among them, as three arrays."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(labels["doc_id"].alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = masks.join(materialize(marks, "marks"), "id", "left").select(
        "part", "mask", F.lit(1).alias("n"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    counted = marked.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])
    filled_in = [
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << n_filters)]).alias(c)
        for c in COUNTS
    ]
    return counted.groupBy("part").agg(*filled_in)


def gray_walk(counts: np.ndarray, n_filters: int) -> np.ndarray:
    """Survivors of every set of filters.  ``counts`` and the result: parts x masks (or sets) x kinds of documents."""
    size = 1 << n_filters
    states = np.zeros_like(counts)
    failing = np.zeros(size, np.int64)  # of each mask cell: how many active filters it fails
    survivors = counts.sum(axis=1)
    states[:, 0] = survivors
    masks = np.arange(size)
    active = 0
    for step in range(1, size):
        bit = step & -step
        active ^= bit
        hit = masks[masks & bit > 0]
        if active & bit:
            survivors = survivors - counts[:, hit[failing[hit] == 0]].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            survivors = survivors + counts[:, hit[failing[hit] == 0]].sum(axis=1)
        states[:, active] = survivors
    return states


def steps(states: np.ndarray, n_filters: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Orders, and for parts x orders x steps the columns of ``RESULTS``."""
    orders = list(permutations(range(n_filters)))
    order = np.array(orders)
    after = np.cumsum(1 << order, axis=1)
    before = after - (1 << order)
    lost = states[:, before] - states[:, after]  # parts x orders x steps x kinds
    full = (1 << n_filters) - 1
    alone = 1 << np.arange(n_filters)
    fails = states[:, [0]] - states[:, alone]
    unique = states[:, full - alone] - states[:, [full]]
    shapley = np.stack([np.where(order == f, lost[..., 0], 0).sum(axis=(1, 2)) for f in range(n_filters)], axis=1)
    columns = [
        states[:, after, 0], lost[..., 0], fails[:, order, 0] - lost[..., 0], unique[:, order, 0],
        lost[..., 1], lost[..., 2], shapley[:, order],
    ]
    return ["".join(FILTERS[f] for f in o) for o in orders], order, np.stack(columns, axis=-1)


def audit(counted: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """One row per part, order of the filters and step."""
    per_part = factorial(n_filters) * n_filters
    own = [StructField("part", StringType()), StructField("filter_order", StringType()), StructField("step", IntegerType())]
    out = StructType([*own, *[StructField(c, LongType()) for c in RESULTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                kinds = [batch.column(i).flatten().to_numpy().reshape(-1, 1 << n_filters) for i in (1, 2, 3)]
                names, order, columns = steps(gray_walk(np.stack(kinds, axis=-1).astype(np.int64), n_filters), n_filters)
                which = np.repeat(np.arange(batch.num_rows), per_part)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(which)),
                    pa.array(names, pa.string()).take(pa.array(np.tile(np.repeat(np.arange(len(names)), n_filters), batch.num_rows))),
                    pa.array(np.tile(np.arange(1, n_filters + 1, dtype=np.int32), batch.num_rows * len(names))),
                    *[pa.array(np.ascontiguousarray(columns[..., c]).reshape(-1)) for c in range(len(RESULTS))],
                ], names=out.names)

    return counted.select("part", *COUNTS).mapInArrow(run, out)


# --- the query and its twin -------------------------------------------------------------------------------------------


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(cells(failures(docs), labels))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
    FROM f p, f q, f r, f s, f u WHERE p.b + q.b + r.b + s.b + u.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5),
k AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS ahead
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (ahead + bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & ahead = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & ahead > 0 AND mask & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & ahead = 0 AND mask & bit > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & ahead = 0 AND mask & bit > 0), 0) AS toxic_lost
    FROM c, k GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r"""
