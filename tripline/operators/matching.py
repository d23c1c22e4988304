"""One-to-one matching of scored pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.session import settle


def greedy_matching(pairs: DataFrame, left: Sequence[str], right: Sequence[str], score: str = "score", tie: Sequence[str] = ()) -> DataFrame:
    """The pairs that a walk from the best score down would take, each side used once at most.

    Ties go by ``tie``, then by the keys.  A pair that is the best of both its sides can be taken whatever the
    rest is, and taking it changes nothing for pairs of other sides; so every round takes all such pairs at once and drops what
    they rule out, until none is left.  The best of a side is a minimum, combined before the shuffle.  Rows that repeat a pair
    count by their best; rows with a null score or key take no part.
    """
    left, right = list(left), list(right)
    keys = [*left, *[c for c in right if c not in left]]
    known = pairs.dropna(subset=[*keys, score])
    place = F.struct((-F.col(score)).alias("s"), *[F.col(c) for c in [*tie, *keys]])
    rows = settle(known.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in pairs.columns]), place).alias("r")).select("r.*"))
    taken = None
    while not rows.isEmpty():
        tops = [rows.groupBy(*side).agg(F.min_by(F.struct(*keys), place).alias("k")).select("k.*") for side in (left, right)]
        both = settle(tops[0].join(tops[1], keys, "left_semi"))
        now = rows.join(both, keys, "left_semi")
        taken = now if taken is None else taken.unionByName(now)
        rows = settle(rows.join(both.select(left), left, "left_anti").join(both.select(right), right, "left_anti"))
    return rows if taken is None else taken
