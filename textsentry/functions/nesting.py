"""How many rounds of repeated groups a match may have open at once, read off a pattern's structure.

Java's regex calls itself once per round of a repeated group, also for rounds
of a group inside it and for what follows. A pattern is cut into its groups and
folded over them with a stack: a group's rounds are its bound times one more
than the rounds inside; possessive and atomic groups hand their rounds back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Counted for a repeat without a bound.
ENDLESS = 1e9

# What a pattern is made of here: quoted text, escapes, classes, group ends with their
# repeats, group starts, and any other character.
_PARTS = (
    r"(?s)\\Q.*?(?:\\E|\z)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]"
    r"|\)(?:[*+?]|\{\d+(?:,\d*)?\})?[+?]?|\(\?>|\(|[^\\\[()]+|."
)


def _bound(part: Column) -> Column:
    """The most rounds of the repeat behind a group's end: 0 if there is none, as for an optional group."""
    count = F.regexp_extract(part, r"^\)\{(\d+)(?:,(\d*))?\}", 0)
    low, high = (F.regexp_extract(part, r"^\)\{(\d+)(?:,(\d*))?\}", i) for i in (1, 2))
    most = F.when(high != "", high).when(F.contains(count, F.lit(",")), None).otherwise(low)
    return (
        F.when(F.rlike(part, F.lit(r"^\)[*+]")), F.lit(ENDLESS))
        .when(count != "", F.least(F.coalesce(most.cast("double"), F.lit(ENDLESS)), F.lit(ENDLESS)))
        .otherwise(0.0)
    )


def open_rounds(pattern: Column) -> Column:
    """The most rounds that are open at once; ``ENDLESS`` or more where there is no bound."""
    parts = F.filter(F.regexp_extract_all(pattern, F.lit(_PARTS), F.lit(0)), lambda p: F.rlike(p, F.lit(r"^[()]")))

    def step(state: Column, part: Column) -> Column:
        # Entries are pairs: rounds so far, and whether the group is atomic. The first is the innermost.
        bound, inside = _bound(part), state[0]["rounds"]
        possessive = F.rlike(part, F.lit(r"^\)(?:[*+?]|\{\d+(?:,\d*)?\})\+")) | state[0]["atomic"]
        group = F.when(possessive, inside + 1).when(bound > 0, bound * (inside + 1)).otherwise(inside)
        outer = F.struct((state[1]["rounds"] + group).alias("rounds"), state[1]["atomic"].alias("atomic"))
        opened = F.struct(F.lit(0.0).alias("rounds"), part.startswith("(?>").alias("atomic"))
        return (
            F.when(part.startswith("("), F.concat(F.array(opened), state))
            .when(F.size(state) > 1, F.concat(F.array(outer), F.slice(state, F.lit(3), F.size(state))))
            .otherwise(state)
        )

    start = F.array(F.struct(F.lit(0.0).alias("rounds"), F.lit(False).alias("atomic")))
    return F.aggregate(parts, start, step, lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x["rounds"]))
