"""Participant-disjoint splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.scalars import participant_name, stratum
from vitalframe.operators.ordering import each_number, running


def listed_split(rows: DataFrame, participants: dict[str, DataFrame], key: str = "participant_id") -> dict[str, DataFrame]:
    """One table per list of participants, by semi-joins."""
    return {name: rows.join(ids.select(key).distinct(), key, "left_semi") for name, ids in participants.items()}


def formatted_ids(rows: DataFrame, key: str = "participant_id") -> DataFrame:
    """Older id columns renamed, ids normalised, session and date filled in."""
    for old in ("SUBJECT_ID", "ID"):
        if old in rows.columns and key not in rows.columns:
            rows = rows.withColumnRenamed(old, key)
    rows = rows.withColumn(key, participant_name(F.col(key).cast("string")))
    if "session_id" not in rows.columns:
        rows = rows.withColumn("session_id", F.lit("1"))
    return rows if "datetime" in rows.columns else rows.withColumn("datetime", F.lit("0000-01-01"))


def hash_split(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 42, strata: str | None = None) -> DataFrame:
    """Each participant's part: ranked by a hash of id and seed, cut at the cumulative shares, within strata if given.

    Ranking is over participants, one row each; the rows themselves are never sorted.
    """
    own = [strata] if strata else []
    people = rows.select(key, *own).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    # The hash's first digits cut people into ranges of equal size; the key parts equal hashes.
    people = people.withColumn("_place", F.struct("_h", key))
    ranked = running(people, "_place", F.lit(1), "_rank", own, F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    size = people.groupBy(*own).agg(F.count(F.lit(1)).alias("_size"))
    people = (ranked.join(size, own) if own else ranked.crossJoin(F.broadcast(size))).withColumn("_u", (F.col("_rank") - 0.5) / F.col("_size"))
    total, chosen, names = 0.0, None, list(shares)
    for name in names[:-1]:
        total += shares[name]
        chosen = F.when(F.col("_u") < total, name) if chosen is None else chosen.when(F.col("_u") < total, name)
    last = F.lit(names[-1])
    return people.select(key, *own, (last if chosen is None else chosen.otherwise(last)).alias("part"))


def stratified_split(rows: DataFrame, key: str, target: str, shares: dict[str, float], low: float, high: float, seed: int = 42, least: int = 2) -> DataFrame:
    """hash_split within glucose classes of the participants' medians; unstratified if a class has fewer than `least`."""
    people = rows.groupBy(key).agg(F.median(target).alias("_m")).select(key, stratum("_m", low, high).alias("class"))
    sizes = people.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()  # three classes
    return hash_split(people, key, shares, seed, "class" if all(r["n"] >= least for r in sizes) else None)


#: The participants of the third dataset's split; its validation list is its test list.
FIXED_IEB3 = {"train": ["ieb_01", "ieb_02", "ieb_03", "ieb_04", "ieb_06", "ieb_08"], "validation": ["ieb_05", "ieb_07"], "test": ["ieb_05", "ieb_07"]}


def fixed_split(rows: DataFrame, lists: dict[str, list] = FIXED_IEB3, key: str = "participant_id") -> dict[str, DataFrame]:
    """One table per list of participants that is given by name."""
    return {part: rows.where(F.col(key).isin(list(ids))) for part, ids in lists.items()}


def overlapping(parts: dict[str, DataFrame], key: str) -> list[tuple[str, str]]:
    """Pairs of parts that share a participant."""
    names = list(parts)
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if not parts[a].select(key).intersect(parts[b].select(key)).isEmpty()]


def group_folds(rows: DataFrame, key: str, folds: int) -> DataFrame:
    """(key, fold): groups in falling order of size, then by key, go each to the fold with the fewest rows so far.

    Groups of one size that go to folds with given loads take these in the order of load + size * j over all folds and
    j = 0, 1, ...; so a group's place within its size tells its fold, and the driver reads only how many groups there
    are of each size.
    """
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    sizes = groups.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_size")).collect()
    load, plan = [0] * folds, []
    for r in sizes:
        size, left = r["_size"], r["n"]
        low, high = min(load), max(load) + size * (left + 1)
        while low < high:  # the least level below which the folds take that many groups
            level = (low + high) // 2
            if sum(max(0, -(-(level - x) // size)) for x in load) >= left:
                high = level
            else:
                low = level + 1
        taken = [max(0, -(-(low - x) // size)) for x in load]
        over = sum(taken) - left
        for f in reversed(range(folds)):  # of the folds that reach the level last, the higher ones wait
            if over and taken[f] and load[f] + size * (taken[f] - 1) == low - 1:
                taken[f] -= 1
                over -= 1
        plan.append((size, list(load), taken))
        load = [x + size * n for x, n in zip(load, taken)]
    spark = rows.sparkSession
    steps = spark.createDataFrame([(size, f, n, at, at[f]) for size, at, taken in plan for f, n in enumerate(taken) if n], "_size long, fold int, _taken long, _loads array<long>, _load long")
    steps = each_number(steps, F.lit(0), F.col("_taken") - 1, "_j")
    value = F.col("_load") + F.col("_j") * F.col("_size")
    earlier = lambda x, f: F.greatest(F.lit(0).cast("long"), F.floor((value - x + F.when(f < F.col("fold"), F.col("_size")).otherwise(F.col("_size") - 1)) / F.col("_size")).cast("long"))
    nth = F.aggregate(F.transform("_loads", earlier), F.lit(1).cast("long"), lambda s, x: s + x)
    steps = steps.select("_size", "fold", nth.alias("_nth"))
    ranked = running(groups, key, F.lit(1), "_nth", ["_size"])
    return ranked.join(steps, ["_size", "_nth"]).select(key, "fold")
