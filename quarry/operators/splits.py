"""Splits of a labelled dataset by groups, so that rare labels get into the held-out parts and no group stands in two."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.scratch import Scratch

#: A label's share of a group's score is UNIT over the number of groups left that have it, floored, so that sums are exact.
UNIT = 10**12


def _overlap(labels: Iterable[str]) -> Column:
    known = sorted(labels)
    return F.arrays_overlap("labels", F.array(*map(F.lit, known))) if known else F.lit(False)


def _last_of(groups: DataFrame, limits: dict[str, int]) -> str | None:
    """The place of the group, in order, at which the first label reaches its limit; '*' stands for all groups. None if no label does.

    Groups are numbered in ranges of their places, which are hashes, so no task holds all groups of a label.
    """
    cells = groups.select("place", F.substring("place", 1, 3).alias("cell"), F.explode(F.array_append("labels", F.lit("*"))).alias("label"))
    sums = cells.groupBy("label", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("label")]
    # Only the cell in which a label's limit lies is numbered.
    met = sums.select("label", "cell", (limit - before).alias("rank"), "n").where("rank BETWEEN 1 AND n").drop("n")
    number = F.row_number().over(Window.partitionBy("label", "cell").orderBy("place"))
    return cells.join(F.broadcast(met), ["label", "cell"]).withColumn("number", number).where("number = rank").agg(F.min("place")).first()[0]  # a row for each label


def stratified_groups(rows: DataFrame, group: str, labels: str, may_hold_out: Column | None = None, share: int = 10, parts: tuple[str, ...] = ("test", "validation"), seed: str = "seed") -> DataFrame:
    """(group, split): each group in one of parts, or in train. A part gets max(1, groups / share) groups, one after the other, each time the one that

    * leaves every label that it has in some other group, if there is such a group,
    * and of these has the largest sum, over its labels that the part doesn't have yet, of one over the number of groups left with that label;
    * ties go by a hash of seed and group.

    So rare labels come first, and are not used up. may_hold_out: rows of which all must hold for the group to be held out.

    The choice is that of going through all groups for each pick, but it takes a number of jobs that depends on the labels only: while a
    part lacks labels, a pick is one ordered look; once it has all, groups follow in order until a label comes down to its last group, and such a stretch is found and
    counted at once. The labels (a fixed taxonomy) and their counts are held by the driver; groups never are.

    Null labels are none; a group without labels is taken in order. Fewer groups than parts and train need, or too few that may be held out, are an error.
    """
    scratch = Scratch(rows.sparkSession, "splits")
    fine = F.coalesce(may_hold_out, F.lit(False)) if may_hold_out is not None else F.lit(True)
    each = rows.select(F.col(group).alias("group"), fine.alias("fine"), F.explode_outer(labels).alias("label"))
    own = each.groupBy("group").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.bool_and("fine").alias("fine"))
    place = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("group").cast("string"), F.lit(""))), 256)
    groups = scratch.table(own.withColumn("place", place), "groups")
    total = groups.count()
    if total <= len(parts):
        raise ValueError(f"{total} groups are too few for {len(parts)} parts and a rest")
    counts = {r.label: r.n for r in groups.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}  # the taxonomy
    split: Column | None = None
    for part in parts:
        need, covered = max(1, total // share), set()
        while need:
            left = groups.where("fine") if split is None else groups.where("fine").where(split.isNull())
            safe = ~_overlap(k for k, n in counts.items() if n <= 1)
            gains = [F.when(F.array_contains("labels", k), F.lit(UNIT // n)).otherwise(0) for k, n in sorted(counts.items()) if n and k not in covered]
            score = sum(gains, F.lit(0)).cast("long")
            best = left.select("place", "labels", safe.alias("safe"), score.alias("score")).orderBy(F.desc("safe"), F.desc("score"), "place").first()
            if best is None:
                raise ValueError("too few groups may be held out")
            if best.score:
                taken, lost = F.col("place") == best.place, dict.fromkeys(best.labels, 1)
                covered |= set(best.labels)
                need -= 1
            else:
                open_ = safe if best.safe else F.lit(True)
                limits = {"*": need} | ({k: n - 1 for k, n in counts.items() if n > 1} if best.safe else {})
                last = _last_of(left.where(open_), limits)
                taken = open_ if last is None else open_ & (F.col("place") <= last)
                sums = left.where(taken).select(F.explode(F.array_append("labels", F.lit("*"))).alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()  # the taxonomy
                lost = {r.label: r.n for r in sums}
                need -= lost.pop("*")
            counts = {k: n - lost.get(k, 0) for k, n in counts.items()}
            taken = F.col("fine") & taken
            split = F.when(taken, part) if split is None else split.when(taken, part)
    return groups.select("group", F.coalesce(split, F.lit("train")).alias("split"))


def quotas(total: int, shares: dict[int, float]) -> dict[int, int]:
    """total cut by shares, by largest remainders; ties to the smaller key."""
    whole = sum(shares.values())
    exact = {k: total * s / whole for k, s in shares.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(shares, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def assemble(rows: DataFrame, total: int, shares: dict[int, float], cap: int = 5, cover: int = 100, seed: str = "seed") -> DataFrame:
    """(id, n_labels, chosen, reason) for rows (id, group, key, labels, mandatory): a dataset of at most `total` rows, of which each number of labels gets its share.

    * Of rows with the same key, the first by mandatory and id stays (else duplicate); a null key is unlike all others.
    * Of a group, `cap` rows stay, mandatory ones first, then in the order of ids (else cap).
    * Of the rows of each number of labels, as many are chosen as its quota says (else quota; unwanted, if there is no share for it): mandatory ones first; then, among rows of a single
      label, the first of each group for up to `cover` groups of that label, so that every label comes from many groups; then the rest, in the order of a hash of seed and id.

    Quotas are largest remainders of the shares. A quota that can't be filled isn't moved to another number of labels. Null labels count as none.
    """
    place = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    labels, needed = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("labels", F.array().cast("array<string>"))))), F.coalesce(F.col("mandatory"), F.lit(False))
    own = rows.select("id", "group", F.coalesce(F.col("key").cast("string"), F.concat(F.lit("\0"), F.col("id").cast("string"))).alias("key"), labels.alias("labels"), needed.alias("mandatory"), place.alias("place"))
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mandatory"), "id"))
    keep = own.groupBy("key").agg(F.min(F.struct(~F.col("mandatory"), F.col("id"))).alias("_first")).select(F.col("key").alias("_key"), F.col("_first.id").alias("_kept"))
    own = own.join(keep, F.col("key") == F.col("_key")).withColumn("repeated", F.col("id") != F.col("_kept"))
    first = own.where("NOT repeated").select(F.col("id").alias("_id"), number("group").alias("_in_group"))
    own = Scratch(rows.sparkSession, "assemble").table(own.join(first, F.col("id") == F.col("_id"), "left").withColumn("reason", F.when(F.col("repeated"), "duplicate").when(F.col("_in_group") > cap, "cap")).select("id", "group", "labels", "mandatory", "place", "reason"), "capped")
    left = own.where("reason IS NULL").withColumn("n_labels", F.size("labels"))
    # One row for each group and single label, by place; mandatory rows cover their groups already.
    single = left.where("n_labels = 1").groupBy(F.col("labels")[0].alias("label"), "group").agg(F.min(F.struct(~F.col("mandatory"), F.col("place"), F.col("id"))).alias("_r"))
    by_label = Window.partitionBy("label").orderBy("_r")
    covering = single.withColumn("_n", F.row_number().over(by_label)).where(F.col("_n") <= cover).select(F.col("_r.id").alias("_cover"))
    ranked = left.join(covering, F.col("id") == F.col("_cover"), "left")
    order = Window.partitionBy("n_labels").orderBy(F.desc("mandatory"), F.col("_cover").isNull(), "place", "id")
    share = F.create_map(*(F.lit(x) for pair in quotas(total, shares).items() for x in pair))[F.col("n_labels")]
    # Only the first rows of each number of labels are numbered, as many as the largest quota.
    chosen = ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.lit(total)).where(F.col("_n") <= share).select(F.col("id").alias("_chosen"))
    done = own.join(chosen, F.col("id") == F.col("_chosen"), "left").withColumn("n_labels", F.size("labels"))
    reason = F.coalesce("reason", F.when(F.col("_chosen").isNull(), F.when(F.col("n_labels").isin(list(shares)), "quota").otherwise("unwanted")))
    return done.select("id", "n_labels", F.col("_chosen").isNotNull().alias("chosen"), reason.alias("reason"))
