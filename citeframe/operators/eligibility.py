"""Which records satisfy a question's hard constraints.

Questions are reduced to distinct signatures. A signature meets a record through hash keys: type,
flag and category, each possibly "any", and every one of its limits. A limit is a key too: values
are replaced by the number of distinct limits they reach, and "reaches more than d" is the disjoint
union of one dyadic interval per zero bit of d, of which a value lies in one per one bit of its
own. So each pair meets through exactly one interval of each limit, and whatever meets is a result
(but for records that share several of the wanted categories).

Records take the keys one limit after the other, as a range tree is descended: before the next
limit, keys nobody asks for are dropped by a semi-join. A signature has at most one key per
combination of zero bits, the cube of the logarithm of the number of limits where it sets three.

Counts, empty results and first-k lists never form (signature, record) pairs: records are first
folded into cells, which are equal for every constraint any signature asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, part_of
from .joins import lookup_join
from .profile import WANTS, lowered, with_signature
from .ranking import running_sum, top_k

ANY = "*"
PLAIN_KEYS = ("k_type", "k_flag", "k_cat")
# (limit on the signature, record column, sign that turns the test into "record >= limit")
RANGES = (("max_fee", "fee", -1), ("own_score", "cutoff", -1), ("min_placement", "placement", 1))
NO_LIMIT = 0


def signatures(profiled: DataFrame) -> DataFrame:
    """Distinct constraint sets that ask for something, numbered, cut for reuse (which also fixes
    the numbers)."""
    distinct = profiled.where("applied").select("sig", *WANTS).dropDuplicates(["sig"])
    return cut(distinct.withColumn("sid", F.monotonically_increasing_id()))


def _shift(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level)


def _intervals(step: Column, bits: int, bit: int, beside: int) -> Column:
    """Keys of the dyadic intervals at the levels where ``step`` has ``bit``: the one it lies in, or a
    number of blocks ``beside`` it. Intervals are numbered as the nodes of a heap; asked for and
    offered are odd ones only, so that none is taken for another level's."""
    levels = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda level: _shift(step, level) % 2 == bit)
    root = F.lit(1 << bits).cast("long")
    return F.transform(levels, lambda level: _shift(root, level) + _shift(step, level) + beside)


def _asked_limits(reached: dict[str, int]) -> list[tuple[str, str, int]]:
    """(limit, record column, bits of its scale) of the limits any signature sets."""
    return [(limit, value, reached[limit].bit_length()) for limit, value, _ in RANGES if reached[limit]]


def _keys(reached: dict[str, int]) -> list[str]:
    return [*PLAIN_KEYS, *[f"k_{limit}" for limit, _, _ in _asked_limits(reached)]]


def _signature_keys(sigs: DataFrame, reached: dict[str, int]) -> DataFrame:
    """Keys of slotted signatures: the intervals above a limit are the zero bits of the step below it."""
    any_cat = F.array(F.lit(ANY))
    out = (
        sigs.withColumn("k_type", F.coalesce("want_type", F.lit(ANY)))
        .withColumn("k_flag", F.when(F.col("want_flag"), F.lit("yes")).otherwise(ANY))
        .withColumn("k_cat", F.explode(F.when(F.size("want_cats") > 0, F.col("want_cats")).otherwise(any_cat)))
    )
    for limit, _, bits in _asked_limits(reached):
        above = _intervals(F.col(f"s_{limit}") - 1, bits, 0, 1)
        out = out.withColumn(
            f"k_{limit}", F.explode(F.when(F.col(f"s_{limit}").isNotNull(), above).otherwise(F.array(F.lit(NO_LIMIT).cast("long"))))
        )
    return out


def _record_keys(records: DataFrame, keyed: DataFrame, reached: dict[str, int], spread: Sequence[str]) -> DataFrame:
    """A slotted record can be asked for by its type or any type, and so on, and through each interval its
    values lie in: the one bits of the steps they reach. Of these, the keys that a prefix of ``keyed`` has; the
    last limit's are left to the join itself."""
    out = (
        records.withColumn("k_type", F.explode(F.array_compact(F.array(F.col("type"), F.lit(ANY)))))
        .withColumn("k_flag", F.explode(F.array_compact(F.array(F.when(F.col("flag"), F.lit("yes")), F.lit(ANY)))))
        .withColumn("k_cat", F.explode(F.concat(F.col("categories"), F.array(F.lit(ANY)))))
    )
    prefix = list(PLAIN_KEYS)
    for limit, value, bits in _asked_limits(reached):
        asked = part_of(keyed.select(*prefix), keyed)
        inside = F.when(
            F.col(f"s_{value}").isNotNull(), _intervals(F.col(f"s_{value}"), bits, 1, 0)
        ).otherwise(F.array().cast("array<bigint>"))
        out = lookup_join(out, asked, prefix, spread, "left_semi").withColumn(
            f"k_{limit}", F.explode(F.concat(F.array(F.lit(NO_LIMIT).cast("long")), inside))
        )
        prefix.append(f"k_{limit}")
    return out


def candidates(sigs: DataFrame, records: DataFrame, reached: dict[str, int], spread: Sequence[str]) -> DataFrame:
    """Slotted signatures and records that meet on every key: each pair once per category they share."""
    keyed = cut(_signature_keys(sigs, reached))
    return lookup_join(_record_keys(records, keyed, reached, spread), keyed, _keys(reached), spread)


def _within_limits() -> Column:
    test = F.lit(True)
    for limit, value, sign in RANGES:
        inside = F.col(value) >= F.col(limit) if sign > 0 else F.col(value) <= F.col(limit)
        test = test & (F.col(limit).isNull() | inside)
    return test


def _first_shared_category() -> Column:
    """A record reached through several wanted categories counts through the first only."""
    return (F.col("k_cat") == ANY) | (
        F.col("k_cat") == F.get(F.array_intersect("want_cats", "categories"), F.lit(0))
    )


def is_eligible() -> Column:
    """The constraints as one predicate over a row that has both sides' columns."""
    return (
        (F.col("want_type").isNull() | (F.col("type") == F.col("want_type")))
        & (~F.col("want_flag") | F.col("flag"))
        & ((F.size("want_cats") == 0) | F.arrays_overlap("want_cats", "categories"))
        & _within_limits()
    )


def _signed(column: str, sign: int) -> Column:
    """As a double that must reach its limit; zero has no sign."""
    return F.col(column).cast("double") * sign + F.lit(0.0)


def _slotted(sigs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Both sides with range values replaced by the number of distinct limits they reach (same
    order, fewer values), and how many limits there are of each kind.

    Values and limits are ordered together, range-partitioned; nothing but three counts comes to
    the driver.
    """
    slim = records.select("row_idx", "type", "flag", "categories", *[value for _, value, _ in RANGES])
    seen = None
    for limit, value, sign in RANGES:
        for side, column, is_limit in ((sigs, limit, 1), (slim, value, 0)):
            part = side.where(F.col(column).isNotNull()).select(
                F.lit(limit).alias("limit"), _signed(column, sign).alias("v"), F.lit(is_limit).alias("is_limit")
            )
            seen = part if seen is None else seen.unionByName(part)
    distinct = seen.groupBy("limit", "v").agg(F.max("is_limit").alias("is_limit"))
    steps = cut(running_sum(distinct, "limit", "v", "is_limit", "step"))
    reached = {limit: 0 for limit, _, _ in RANGES}
    reached |= {r["limit"]: r["n"] for r in steps.groupBy("limit").agg(F.max("step").alias("n")).collect()}
    for limit, value, sign in RANGES:
        own = steps.where(F.col("limit") == limit)
        for column in (value, limit):
            scale = part_of(own.select(F.col("v").alias("_v"), F.col("step").alias(f"s_{column}")), steps)
            if column == value:
                keyed = slim.withColumn("_v", _signed(column, sign))
                slim = lookup_join(keyed, scale, ["_v"], ["row_idx"], "left").drop("_v", column)
            else:
                keyed = sigs.withColumn("_v", _signed(column, sign))
                sigs = lookup_join(keyed, scale, ["_v"], ["sid"], "left").drop("_v")
    return sigs, slim, reached


def eligible_pairs(sigs: DataFrame, records: DataFrame) -> DataFrame:
    """(sid, row_idx) for every record a signature admits."""
    slotted_sigs, slim, reached = _slotted(sigs, records)
    met = candidates(slotted_sigs, slim, reached, ["row_idx"])
    return met.where(_first_shared_category()).select("sid", "row_idx")


CELL = ("type", "flag", "categories", *[f"s_{value}" for _, value, _ in RANGES])


def _cells_by_signature(sigs: DataFrame, cells: DataFrame, reached: dict[str, int]) -> DataFrame:
    return candidates(sigs, cells, reached, CELL).where(_first_shared_category())


def eligible_summary(sigs: DataFrame, records: DataFrame) -> DataFrame:
    """(sig, n_eligible, first_row, row_sum) for every signature; first_row and row_sum, which
    identify the set, are NULL where it is empty."""
    slotted_sigs, slim, reached = _slotted(sigs, records)
    cells = slim.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.min("row_idx").alias("first"), F.sum("row_idx").alias("total")
    )
    merged = _cells_by_signature(slotted_sigs, cells, reached).groupBy("sid").agg(
        F.sum("n").alias("n"), F.min("first").alias("first_row"), F.sum("total").alias("row_sum")
    )
    return sigs.join(merged, "sid", "left").select(
        *sigs.columns, F.coalesce("n", F.lit(0)).cast("long").alias("n_eligible"), "first_row", "row_sum"
    )


def nothing_wanted() -> dict[str, Column]:
    return {
        "want_type": F.lit(None).cast("string"),
        "want_flag": F.lit(False),
        "want_cats": F.array().cast("array<string>"),
        "max_fee": F.lit(None).cast("double"),
        "own_score": F.lit(None).cast("double"),
        "min_placement": F.lit(None).cast("double"),
    }


def only_constraint(profiled: DataFrame, *kept: str) -> DataFrame:
    """Questions with every constraint but the kept ones lifted, where one of those is set."""
    lifted = profiled.withColumns({c: e for c, e in nothing_wanted().items() if c not in kept})
    is_set = {
        "want_flag": F.col("want_flag"),
        "want_cats": F.size("want_cats") > 0,
    }
    applied = F.lit(False)
    for c in kept:
        applied = applied | is_set.get(c, F.col(c).isNotNull())
    return with_signature(lifted.withColumn("applied", applied))


def first_eligible(sigs: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(sid, row_idx): the first k admitted records in catalogue order."""
    slotted_sigs, slim, reached = _slotted(sigs, records)
    order = [F.col("row_idx").asc()]
    heads = top_k(slim, CELL, order, k).drop("rn")
    return top_k(
        _cells_by_signature(slotted_sigs, heads, reached).select("sid", "row_idx"), ["sid"], order, k
    ).drop("rn")


def unique_counts(profiled: DataFrame, records: DataFrame) -> DataFrame:
    """(uq, applied, n_eligible) per distinct question: NULL count where it sets no constraint."""
    counts = eligible_summary(signatures(profiled), records).select("sig", "n_eligible")
    return profiled.select("uq", "applied", "sig").join(counts, "sig", "left").select(
        "uq", "applied", "n_eligible"
    )


def question_counts(questions: DataFrame, profiled: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, question, applied, n_eligible) for every question."""
    counts = cut(unique_counts(profiled, records))
    return lookup_join(questions.withColumn("uq", lowered("question")), counts, ["uq"], ["qid"])


def true_negatives(questions: DataFrame, profiled: DataFrame, records: DataFrame) -> DataFrame:
    """Questions whose constraints no record meets: an answer in itself, never widened."""
    empty = cut(unique_counts(profiled, records).where(F.col("applied") & (F.col("n_eligible") == 0)))
    return lookup_join(questions.withColumn("uq", lowered("question")), empty, ["uq"], ["qid"])
