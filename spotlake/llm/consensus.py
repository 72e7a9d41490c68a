"""Consensus from several annotators' labels by iteratively reweighted voting.

Weighted consensus and leave-one-out smoothed accuracy of every annotator alternate until stable. An annotator's
accuracy is kept per consensus label, so that one who calls nearly everything a target weighs little when doing so,
and one who is wrong on purpose weighs negatively. Items with equal votes are one pattern with a count, so the rounds
work on patterns; only tables of annotators x labels are carried from round to round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.scale import broadcast_within, cut, stored

MAX_LABELS = 64


def _patterns(votes: DataFrame, item: list[str]) -> DataFrame:
    """(item, pattern): the item's votes as text, with the number of votes."""
    one = F.to_json(F.struct("annotator", "label"))
    return votes.groupBy(*item).agg(F.array_join(F.sort_array(F.collect_list(one)), ",").alias("pattern"))


def consensus(
    votes: DataFrame, item: list[str], prior_votes: float = 4.0, start_accuracy: float = 0.7, tolerance: float = 1e-4, max_rounds: int = 60, sureness: float = 4.0
) -> tuple[DataFrame, DataFrame, int]:
    """(per item consensus, per annotator reliability, rounds) of ``votes`` (item columns, ``annotator``, ``label``).

    Votes must be unique per item and annotator (bounded by the number of annotators); rows with a null annotator or
    label are ignored, items left without votes do not appear. Ties go to the label first in the alphabet.

    Items: ``label``, ``confidence`` (its posterior share), ``votes``, ``agreement`` (share of the votes equal to the
    label). Annotators and labels: ``accuracy`` on items of that label, smoothed by ``prior_votes`` votes at
    ``start_accuracy``, ``weight`` (the items behind it), and ``converged``: whether the accuracies came to rest within
    ``tolerance`` before ``max_rounds``. A vote counts towards its annotator's accuracy by how sure the item's other votes are
    (their lead over chance to the power of ``sureness``; 0 lets all count alike), else doubtful items would pull every accuracy to the middle.
    """
    votes = votes.where("annotator is not null and label is not null").select(*item, "annotator", "label")
    by_item = stored(_patterns(votes, item))
    counts = by_item.groupBy("pattern").agg(F.count("*").alias("n"))
    shape = "array<struct<annotator: string, label: string>>"
    ballots = counts.withColumn("v", F.from_json(F.concat(F.lit("["), "pattern", F.lit("]")), shape))
    cast = stored(ballots.select("pattern", "n", F.size("v").alias("size"), F.inline("v")))
    labels = [r[0] for r in cast.select("label").distinct().orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    k = len(labels)
    others = max(1, k - 1)
    floor = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-4)), F.lit(1e-4))

    def scored(state: DataFrame, prior: dict[str, float]) -> DataFrame:
        """Each vote with the whole (t_) and the leave-one-out (o_) posterior of every label."""
        rows = cast.join(broadcast_within(state, 100_000), "annotator")
        over = Window.partitionBy("pattern")
        for i, t in enumerate(labels):
            acc = floor(F.col(f"a_{i}"))
            own = F.ln(F.when(F.col("label") == t, acc).otherwise((1 - acc) / others))
            rows = rows.withColumn(f"w_{i}", own).withColumn(f"s_{i}", F.sum(f"w_{i}").over(over) + F.log(F.lit(prior[t])))
        for name, parts in (("t", [F.col(f"s_{i}") for i in range(k)]), ("o", [F.col(f"s_{i}") - F.col(f"w_{i}") for i in range(k)])):
            top = F.greatest(*parts) if k > 1 else parts[0]
            shares = [F.exp(p - top) for p in parts]
            total = sum(shares[1:], shares[0])
            rows = rows.withColumns({f"{name}_{i}": s / total for i, s in enumerate(shares)})
        return rows

    state = cut(cast.select("annotator").distinct().select("annotator", *[F.lit(start_accuracy).alias(f"a_{i}") for i in range(k)]))
    prior = dict.fromkeys(labels, 1.0 / max(1, k))
    rounds, converged = 0, False
    while k and rounds < max_rounds:
        rounds += 1
        rows = scored(state, prior)
        top = F.greatest(*[F.col(f"o_{i}") for i in range(k)]) if k > 1 else F.lit(1.0)
        sure = F.pow((k * top - 1) / others, F.lit(float(sureness))) if k > 1 else F.lit(1.0)
        mass = [F.sum(F.col("n") * sure * F.col(f"o_{i}")) for i in range(k)]
        right = [F.sum(F.when(F.col("label") == t, F.col("n") * sure * F.col(f"o_{i}")).otherwise(0.0)) for i, t in enumerate(labels)]
        share = [F.sum(F.col("n") * F.col(f"t_{i}") / F.col("size")).alias(f"p_{i}") for i in range(k)]
        new = [((r + prior_votes * start_accuracy) / (m + prior_votes)).alias(f"a_{i}") for i, (r, m) in enumerate(zip(right, mass, strict=True))]
        after = cut(rows.groupBy("annotator").agg(*new, *share, *[m.alias(f"m_{i}") for i, m in enumerate(mass)]))
        before = state.select(F.col("annotator").alias("was"), *[F.col(f"a_{i}").alias(f"b_{i}") for i in range(k)])
        moved = F.greatest(F.lit(0.0), *[F.abs(F.col(f"a_{i}") - F.col(f"b_{i}")) for i in range(k)])
        seen = after.join(before, F.col("annotator") == F.col("was")).agg(F.max(moved), *[F.sum(f"p_{i}") for i in range(k)]).first()
        total = sum(seen[1:])
        prior = {t: max(seen[1 + i] / total, 1e-6) for i, t in enumerate(labels)}
        state = after
        if seen[0] < tolerance:
            converged = True
            break
    if not k:
        empty = cast.select("pattern", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"), F.col("size").alias("votes"), F.lit(None).cast("double").alias("agreement"))
        annotators = cast.select("annotator", "label", F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("weight"), F.lit(True).alias("converged"))
        return by_item.join(empty, "pattern").drop("pattern"), annotators, 0
    final = scored(state, prior)
    best = F.greatest(*[F.col(f"t_{i}") for i in range(k)]) if k > 1 else F.col("t_0")
    pick = F.coalesce(*[F.when(F.col(f"t_{i}") == best, F.lit(t)) for i, t in enumerate(labels)])
    chosen = final.select("pattern", "size", pick.alias("picked"), best.alias("confidence"), "label")
    per_pattern = chosen.groupBy("pattern").agg(
        F.first("picked").alias("label"),
        F.first("confidence").alias("confidence"),
        F.first("size").alias("votes"),
        (F.sum(F.when(F.col("label") == F.col("picked"), 1).otherwise(0)) / F.first("size")).alias("agreement"),
    )
    entries = F.array(*[F.struct(F.lit(t).alias("label"), F.col(f"a_{i}").alias("accuracy"), F.col(f"m_{i}").alias("weight")) for i, t in enumerate(labels)])
    return by_item.join(per_pattern, "pattern").drop("pattern"), state.select("annotator", F.inline(entries)).withColumn("converged", F.lit(converged)), rounds


def chance_corrected(votes: DataFrame, item: list[str]) -> DataFrame:
    """Krippendorff's alpha for nominal labels with missing ratings, in one row.

    ``units``: items with at least two votes, ``ratings``: their votes, ``observed`` and ``expected`` disagreement and
    ``alpha`` (null if fewer than two items' worth of votes or only one label occurs).
    """
    votes = votes.where("annotator is not null and label is not null")
    cells = votes.groupBy(*item, "label").agg(F.count("*").alias("c"))
    units = cells.groupBy(*item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m > 1")
    summed = units.agg(F.count("*").alias("units"), F.coalesce(F.sum("m"), F.lit(0)).alias("ratings"), F.sum(F.col("m") - F.col("same") / (F.col("m") - 1)).alias("differing"))
    joined = cells.join(units.select(*item), item, "left_semi")
    classes = joined.groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).cast("double").alias("squares"))
    one = summed.withColumn("__one", F.lit(1)).join(classes.withColumn("__one", F.lit(1)), "__one")
    n = F.col("ratings")
    expected = F.try_divide(n * n - F.col("squares"), n * (n - 1))
    observed = F.try_divide(F.col("differing"), n)
    return one.select("units", "ratings", observed.alias("observed"), expected.alias("expected"), (1 - F.try_divide(observed, expected)).alias("alpha"))
