"""Exact random order, bottom-k samples and global positions without a global sort.

The random order of a table is the order of a keyed hash of its row key.  A
sample of exactly ``k`` rows is every row below the hash of the ``k``-th one, and
as many of the rows with just that hash as are still missing.  One scan draws a
quantile sketch of the hashes of each group, which brackets every cut; the next
one counts the rows below each bracket and ranks those inside.  The rows
themselves are only ever filtered, never moved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from pairloom.session import materialize

# Size of a sketch, and the share of rows by which its ranks may be off; both as
# published for this kind of sketch, with some margin.
SKETCH_K = 1024
SKETCH_ERROR = 0.007
# A sketch is asked for the values at these many even steps of rank.
RANK_STEPS = 512
# Rows inside a bracket that one task may rank; larger brackets get a sketch of their own.
RANKED_ROWS = 1 << 20
# Leading hex digits that fit a BIGINT, and those that make the blocks of a global position.
VALUE_DIGITS = 15
BLOCK_DIGITS = 4


@dataclass(frozen=True)
class HashCuts:
    """The last hash that is still inside, per group and name.

    ``table`` has a row per group: its values, then ``_cut_<name>`` and how many of
    the rows with that very hash are inside, ``_take_<name>``; without groups it is
    a single row of values.  A missing group or NULL means that nothing is inside.
    ``tied`` tells whether a cut falls among rows of equal hash.
    """

    groups: tuple[str, ...]
    names: tuple[str, ...]
    table: DataFrame | Row
    tied: bool
    candidate: Column

    def attach(self, df: DataFrame, h: Column) -> DataFrame:
        """Add the cuts of a row's group, and its place among its equals where a cut falls among them.

        Without groups the cuts are literals.  Otherwise their table is joined; its
        size decides how.
        """
        own = [f"_{kind}_{n}" for n in self.names for kind in ("cut", "take")]
        if not self.groups:
            out = df.withColumns({c: F.lit(self.table[c]).cast("string" if c.startswith("_cut") else "bigint") for c in own})
        else:
            named = self.table.select(*[F.col(g).alias(f"_g_{g}") for g in self.groups], *own)
            same = reduce(lambda x, y: x & y, [df[g].eqNullSafe(named[f"_g_{g}"]) for g in self.groups])
            out = df.join(named, same, "left").drop(*[f"_g_{g}" for g in self.groups])
        if not self.tied:
            return out.withColumn("_tie", F.lit(1))
        return self._deal_ties(out, h, df.columns)

    def _deal_ties(self, out: DataFrame, h: Column, columns: Sequence[str]) -> DataFrame:
        """Choose among the rows that share the hash of a cut by a hash of all their columns.

        They are written with a number each, which tells rows apart that are alike in
        all columns, and are cut again: any number of rows may share a hash.
        """
        at = [h == F.col(f"_cut_{n}") for n in self.names]
        marked = out.withColumn("_at", F.coalesce(self.candidate & reduce(or_, at), F.lit(False)))
        whole = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in columns])), 16, "0")
        edge = marked.where("_at").withColumns({"_hash": h, "_own": F.concat(whole, F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))})
        edge = materialize(edge, "tied-rows")
        wanted = {f"_w_{n}": F.when(F.col("_hash") == F.col(f"_cut_{n}"), F.col(f"_take_{n}")).otherwise(0) for n in self.names}
        again = hash_cuts(
            edge, F.col("_own"), {n: F.col(f"_w_{n}") / F.col("total") for n in self.names}, [*self.groups, "_hash"], totals=wanted
        )
        last = again.table.select(
            *[F.col(g).alias(f"_e_{g}") for g in (*self.groups, "_hash")], *[F.col(f"_cut_{n}").alias(f"_last_{n}") for n in self.names]
        )
        same = reduce(lambda x, y: x & y, [edge[g].eqNullSafe(last[f"_e_{g}"]) for g in (*self.groups, "_hash")])
        dealt = edge.join(last, same, "left").withColumn("_tie", F.coalesce(
            F.least(*[F.when(F.col("_own") <= F.col(f"_last_{n}"), F.col(f"_take_{n}")) for n in self.names], F.lit(None).cast("bigint")),
            F.greatest(*[F.col(f"_take_{n}") for n in self.names], F.lit(0).cast("bigint")) + 1,
        ))
        rest = marked.where("NOT _at").withColumn("_tie", F.lit(1).cast("bigint"))
        return rest.drop("_at").unionByName(dealt.select(*[c for c in rest.columns if c != "_at"]))

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop("_tie", *[f"_{kind}_{n}" for n in self.names for kind in ("cut", "take")])


def within(name: str, h: Column) -> Column:
    """Is a hash inside the attached cut?"""
    cut = F.col(f"_cut_{name}")
    return F.coalesce((h < cut) | ((h == cut) & (F.col("_tie") <= F.col(f"_take_{name}"))), F.lit(False))


def hash_cuts(
    df: DataFrame,
    h: Column,
    ranks: Mapping[str, Column],
    group_cols: Sequence[str] = (),
    where: Column | None = None,
    totals: Mapping[str, Column] | None = None,
) -> HashCuts:
    """Find the hash at which exactly ``rank`` rows of each group are inside.

    ``ranks`` are expressions over ``total`` (candidate rows in the group) and
    the per-group sums named in ``totals``.  A rank beyond the group takes all
    of it, a rank of zero none.  ``where`` limits the candidates; ``totals``
    still sums over every row.  Keys may repeat, and groups be as many as rows.
    """
    g, names = list(group_cols), list(ranks)
    candidate = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    base = df.select(
        *g,
        h.alias("_h"),
        F.when(candidate, F.rpad(F.substring(h, 1, VALUE_DIGITS), VALUE_DIGITS, "0")).alias("_v"),
        *[c.alias(f"_t_{n}") for n, c in (totals or {}).items()],
    )
    counted = base.groupBy(*g).agg(
        F.kll_sketch_agg_bigint(_number("_v"), F.lit(SKETCH_K)).alias("_sketch"),
        F.count("_v").alias("total"),
        *[F.sum(f"_t_{n}").alias(n) for n in (totals or {})],
    )
    needs = counted.select(*g, "_sketch", "total", *[F.least(r.cast("bigint"), F.col("total")).alias(f"_need_{n}") for n, r in ranks.items()])
    margin = 1.0
    brackets = None
    while True:
        if brackets is None:
            own = [c for n in names for c in _bracket(n, F.col("_sketch"), F.col("total"), F.col(f"_need_{n}"), margin)]
            brackets = _settled(needs.select(*g, *own), g, "cut-brackets")
        rows = _attached(base.where("_v IS NOT NULL").select(*g, "_h", "_v"), brackets, g)
        largest = _largest(brackets, names)
        if largest > RANKED_ROWS:
            finer = _settled(_finer(rows, g, names), g, "cut-brackets")
            if _largest(finer, names) < 0.9 * largest:
                brackets = finer
                continue
        table = _settled(_ranked(rows, g, names), g, "cuts")
        lost = reduce(or_, [F.col(f"_lost_{n}") for n in names])
        state = table.agg(F.max("_tied"), F.max(lost)).first() if g else (table["_tied"], any(table[f"_lost_{n}"] for n in names))
        if not state[1]:
            return HashCuts(tuple(g), tuple(names), table, bool(state[0]), candidate)
        margin, brackets = 8 * margin, None  # a bracket missed its cut, which happens to one in some thousands


def _number(digits: str) -> Column:
    return F.conv(F.col(digits), 16, 10).cast("bigint")


def _settled(table: DataFrame, g: list[str], name: str) -> DataFrame | Row:
    """A table of groups, written once; without groups its only row."""
    return materialize(table, name) if g else table.first()


def _largest(brackets: DataFrame | Row, names: list[str]) -> int:
    if isinstance(brackets, Row):
        return max((brackets[f"_rows_{n}"] or 0 for n in names), default=0)
    return brackets.agg(F.max(F.greatest(*[F.col(f"_rows_{n}") for n in names], F.lit(0).cast("bigint")))).first()[0] or 0


def _bracket(name: str, sketch: Column, total: Column, need: Column, margin: float) -> list[Column]:
    """Values between which the ``need``-th one lies, and about how many rows lie there too."""
    at = F.try_divide(need, total)
    off = SKETCH_ERROR * margin + F.try_divide(F.lit(1.0), total)
    some = (need >= 1) & (total >= 1)
    steps = F.split(F.lit(",".join(str(i / RANK_STEPS) for i in range(RANK_STEPS + 1))), ",").cast("array<double>")
    values = F.kll_sketch_get_quantile_bigint(sketch, steps)
    step_of = F.greatest(F.floor((at - off) * RANK_STEPS), F.lit(0)), F.least(F.ceil((at + off) * RANK_STEPS), F.lit(RANK_STEPS))
    low, high = (F.when(some, F.get(values, s.cast("int"))) for s in step_of)
    return [
        need.alias(f"_need_{name}"),
        # Beyond its first and last rank a sketch may have dropped a value.
        F.when(at - off <= 0, F.lit("0" * VALUE_DIGITS)).otherwise(_digits(low)).alias(f"_low_{name}"),
        F.when(at + off >= 1, F.lit("F" * VALUE_DIGITS)).otherwise(_digits(high)).alias(f"_high_{name}"),
        F.ceil(F.least(2 * off + 2.0 / RANK_STEPS, F.lit(1.0)) * total).cast("bigint").alias(f"_rows_{name}"),
    ]


def _digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), VALUE_DIGITS, "0"))


def _attached(rows: DataFrame, table: DataFrame | Row, g: list[str]) -> DataFrame:
    """Rows beside the values of their group: literals where there are no groups."""
    if not g:
        kinds = {"_need": "bigint", "_rows": "bigint"}
        return rows.withColumns({c: F.lit(v).cast(kinds.get(c[:5], "string")) for c, v in table.asDict().items()})
    named = table.withColumnsRenamed({c: f"_e_{c}" for c in g})
    same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(named[f"_e_{c}"]) for c in g])
    return rows.join(named, same).drop(*[f"_e_{c}" for c in g])


def _finer(rows: DataFrame, g: list[str], names: list[str]) -> DataFrame:
    """Brackets inside of brackets."""
    v = F.lower("_v")
    inside = {n: (v >= F.col(f"_low_{n}")) & (v <= F.lower(f"_high_{n}")) for n in names}
    parts = rows.groupBy(*g).agg(*[c for n in names for c in (
        F.max(f"_need_{n}").alias(f"_all_{n}"),
        F.count_if(v < F.col(f"_low_{n}")).alias(f"_below_{n}"),
        F.count_if(inside[n]).alias(f"_in_{n}"),
        F.kll_sketch_agg_bigint(F.when(inside[n], _number("_v")), F.lit(SKETCH_K)).alias(f"_sketch_{n}"),
    )])
    bounds = []
    for n in names:
        need = F.col(f"_all_{n}") - F.col(f"_below_{n}")
        own = _bracket(n, F.col(f"_sketch_{n}"), F.col(f"_in_{n}"), need, 1.0)
        bounds += [F.col(f"_all_{n}").alias(f"_need_{n}"), *own[1:]]
    return parts.select(*g, *bounds)


def _ranked(rows: DataFrame, g: list[str], names: list[str]) -> DataFrame:
    """Per group and name the hash of the cut, how many rows with it are inside, and whether the bracket missed it.

    Rows inside a bracket are counted by hash; all others by where they lie between
    the brackets, which leaves a few counts per task.
    """
    v = F.lower("_v")
    low, high = {n: F.col(f"_low_{n}") for n in names}, {n: F.lower(f"_high_{n}") for n in names}
    place = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate([*[v >= low[n] for n in names], *[v > high[n] for n in names]])]
    inside = reduce(or_, [F.coalesce((v >= low[n]) & (v <= high[n]), F.lit(False)) for n in names])
    bounds = [f"_{kind}_{n}" for n in names for kind in ("need", "low", "high")]
    counted = rows.groupBy(*g, reduce(lambda x, y: x + y, place).alias("_place"), F.when(inside, F.col("_h")).alias("_key")).agg(
        F.count("*").alias("_n"), F.min(v).alias("_v"), *[F.max(b).alias(b) for b in bounds]
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"_need_{n}").alias("need"), low[n].alias("low"), high[n].alias("high")) for i, n in enumerate(names)
    ]))
    own = F.when((F.col("_v") >= F.col("_c.low")), F.col("_key"))
    each = counted.select(*g, "_key", "_v", "_n", wanted.alias("_c")).where("_c.need >= 1 AND _v <= _c.high").select(
        *g, F.col("_c.i").alias("_i"), F.col("_c.need").alias("_need"), own.alias("_key"), "_n"
    )
    # Rows below a bracket are ahead of those in it, in any order.
    running = Window.partitionBy(*g, "_i").orderBy(F.col("_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_cum") - F.col("_n")
    found = each.withColumn("_cum", F.sum("_n").over(running)).withColumn("_hit", (F.col("_need") > before) & (F.col("_need") <= F.col("_cum")))
    hit = {n: F.col("_hit") & (F.col("_i") == i) & F.col("_key").isNotNull() for i, n in enumerate(names)}
    take = F.col("_need") - before
    return found.groupBy(*g).agg(
        *[F.max(F.when(hit[n], F.col("_key"))).alias(f"_cut_{n}") for n in names],
        *[F.max(F.when(hit[n], take)).alias(f"_take_{n}") for n in names],
        *[((F.count_if(F.col("_i") == i) > 0) & (F.count_if(hit[n]) == 0)).alias(f"_lost_{n}") for i, n in enumerate(names)],
        F.max(F.coalesce(F.col("_hit") & (take < F.col("_n")), F.lit(False))).alias("_tied"),
    )


def sample_exact(df: DataFrame, k: int, h: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """``k`` rows per group without replacement (all of a smaller group)."""
    cuts = hash_cuts(df, h, {"k": F.lit(k)}, group_cols)
    return cuts.drop(cuts.attach(df, h).where(within("k", h)))


def bottom_k_per_key(df: DataFrame, key_cols: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """First ``k`` rows per key, for any number of keys.

    Spark keeps only ``k`` rows per key and map task before the shuffle, so a
    hot key costs no more than a cold one.
    """
    w = Window.partitionBy(*key_cols).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def global_position(df: DataFrame, block: Column, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """0-based position in the order ``(block, *order)`` over the whole table.

    ``block`` must be a function of the order that keeps blocks bounded: the
    leading digits of a hash, or a dense row number divided by a constant.  Rows
    are numbered inside their block and shifted by the rows of earlier blocks.
    """
    blocked = df.withColumn("_b", block)
    sizes = blocked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return (
        blocked.withColumn("_r", inside)
        .join(offsets, "_b")
        .withColumn(name, (F.col("_o") + F.col("_r") - 1).cast("bigint"))
        .drop("_b", "_o", "_r")
    )


def shuffled_position(df: DataFrame, h: Column, name: str = "pos", digits: int = BLOCK_DIGITS) -> DataFrame:
    """Position of every row in the random permutation given by ``h``."""
    tagged = df.withColumn("_h", h)
    return global_position(tagged, F.substring("_h", 1, digits), [F.col("_h")], name).drop("_h")


def batches(df: DataFrame, pos: Column, size: int, drop_last: bool = False, total: Column | None = None) -> DataFrame:
    """Number fixed-size batches; optionally drop the ragged last one.

    With ``drop_last`` the caller gives the number of rows as ``total``.
    """
    out = df.withColumn("batch_id", F.floor(pos / size).cast("bigint"))
    if not drop_last:
        return out
    if total is None:
        raise ValueError("drop_last needs the total number of rows")
    return out.where(F.col("batch_id") < F.floor(total / size))
