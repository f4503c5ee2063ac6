"""Identity: mapping heads, references, corrections, and rows that are created once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ladder
from .facts import eligibility, heads

#: Strength of a mapping's status; a rejection is a decision and counts as the strongest.
STATUS_RANK = {"fuzzy_candidate": 1, "manual_verified": 2, "exact": 2}
#: What two rows of one instrument must agree on.
INSTRUMENT_IDENTITY = ["native_event_id", "operator", "kind", "payout_currency", "payout_cents_per_contract", "quantity_increment"]


def current_mappings(observations: DataFrame) -> DataFrame:
    """The head of each (instrument, side): the newest observation that none supersedes, with n_heads and ineligible (null if it may be used).

    observations: mapping_id, instrument, side, outcome_id, polarity, status, equivalence, supersedes.
    """
    h = heads(observations, ["instrument", "side"], "mapping_id", "supersedes")
    return h.withColumn("ineligible", eligibility(F.col("status"), F.col("equivalence"), F.col("n_heads")))


def references(mappings: DataFrame, instruments: DataFrame) -> DataFrame:
    """The instrument side of each (venue, outcome_id) that one usable mapping calls direct, or the reason for which there is none.

    mappings: rows of current_mappings; instruments: instrument, venue, native_id. An outcome that no row names is unmapped; several
    direct sides are ambiguous; if the instrument's other side claims the same outcome too, the mapping is inconsistent.
    """
    usable = mappings.where("status <> 'rejected'")
    direct = usable.where("polarity = 'direct'").join(instruments.select("instrument", "venue", "native_id"), "instrument")
    one = F.struct("instrument", "side", "native_id", "mapping_id", "ineligible")
    g = direct.groupBy("venue", "outcome_id").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("m")).select("venue", "outcome_id", "n", "m.*")
    opposite = usable.select("instrument", (1 - F.col("side")).alias("side"), F.col("outcome_id").alias("_o"), (F.col("polarity") == "direct").alias("_direct"))
    g = g.join(opposite, ["instrument", "side"], "left")
    same = F.col("_direct") == (F.col("_o") == F.col("outcome_id"))
    reason = ladder([(F.col("n") > 1, "ambiguous_reference"), (same, "mapping_inconsistent")])
    g = g.withColumn("reason", reason)
    keep = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return g.select("venue", "outcome_id", *map(keep, ("instrument", "side", "native_id", "mapping_id", "ineligible")), "reason")


def lookup(wanted: DataFrame, refs: DataFrame) -> DataFrame:
    """wanted (venue, outcome_id) with the columns of references; without one the reason is unmapped."""
    x = wanted.join(refs.withColumn("_there", F.lit(True)), ["venue", "outcome_id"], "left")
    return x.withColumn("reason", F.when(F.col("_there").isNull(), "unmapped").otherwise(F.col("reason"))).drop("_there")


def corrections(mappings: DataFrame, instruments: DataFrame, outcomes: DataFrame, spec: DataFrame) -> DataFrame:
    """The observations that corrections append, each superseding its side's head; a row with error set is refused.

    spec: venue, native_id, side, method, evidence, and status, polarity, outcome (a team's abbreviation), equivalence, each null to
    carry the head's over. outcomes: outcome_id, event_id, abbreviation.
    """
    x = spec.alias("c").join(instruments.select("venue", "native_id", "instrument"), ["venue", "native_id"], "left")
    h = mappings.select("instrument", "side", F.col("mapping_id").alias("supersedes"), F.col("outcome_id").alias("_o"), F.col("polarity").alias("_p"), F.col("status").alias("_s"), F.col("equivalence").alias("_e"))
    x = x.join(h, ["instrument", "side"], "left")
    home = outcomes.select(F.col("outcome_id").alias("_o"), F.col("event_id").alias("_event"))
    named = outcomes.select(F.col("event_id").alias("_event"), F.col("abbreviation").alias("outcome"), F.col("outcome_id").alias("_named"))
    x = x.join(home, "_o", "left").join(named, ["_event", "outcome"], "left")
    error = ladder([(F.col("instrument").isNull(), "no_instrument"), (F.col("supersedes").isNull(), "no_mapping"), (F.col("outcome").isNotNull() & F.col("_named").isNull(), "no_outcome")])
    return x.select(
        "instrument", "side", F.coalesce("_named", "_o").alias("outcome_id"), F.coalesce("polarity", "_p").alias("polarity"), F.coalesce("status", "_s").alias("status"),
        F.coalesce("equivalence", "_e").alias("equivalence"), "method", "evidence", "supersedes", error.alias("error"),
    )


def new_rows(incoming: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """One incoming row for each key that is not known yet (events, outcomes): the least by all of its columns."""
    first = incoming.groupBy(*key).agg(F.min(F.struct(*(c for c in incoming.columns if c not in key))).alias("_r")).select(*key, "_r.*") if len(incoming.columns) > len(key) else incoming.distinct()
    return first.join(known.select(*key), key, "left_anti").select(*incoming.columns)


def instruments_merged(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming instruments (venue, native_id, side0_id, side1_id and INSTRUMENT_IDENTITY) with action insert, same or conflict.

    A known one keeps its order of sides, given in stored0 and stored1; conflict names in differs what does not agree.
    """
    k = known.select("venue", "native_id", F.col("side0_id").alias("_s0"), F.col("side1_id").alias("_s1"), *(F.col(c).alias(f"_{c}") for c in INSTRUMENT_IDENTITY), F.lit(True).alias("_there"))
    x = incoming.join(k, ["venue", "native_id"], "left")
    sides = F.array_sort(F.array("side0_id", "side1_id")) != F.array_sort(F.array("_s0", "_s1"))
    checks: list[Column] = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in INSTRUMENT_IDENTITY] + [F.when(sides, "sides")]
    differs = F.when(F.col("_there"), F.array_compact(F.array(*checks))).otherwise(F.array().cast("array<string>"))
    action = F.when(F.col("_there").isNull(), "insert").when(F.size(differs) > 0, "conflict").otherwise("same")
    return x.select(*incoming.columns, action.alias("action"), F.coalesce("_s0", "side0_id").alias("stored0"), F.coalesce("_s1", "side1_id").alias("stored1"), differs.alias("differs"))


def mappings_merged(incoming: DataFrame, mappings: DataFrame) -> DataFrame:
    """incoming mappings (instrument, side, outcome_id, polarity, status, equivalence, rules, evidence) against the heads: action and what to write.

    insert: none yet. supersede: the same claim under a stronger status; a settlement verdict on the head is carried over unless this source
    has other rules. same: the head says as much. conflict: another outcome or polarity, or another settlement verdict.
    mappings: heads with mapping_id and rules too.
    """
    rank = lambda c, none: reduce(lambda e, kv: F.when(F.col(c) == kv[0], kv[1]).otherwise(e), STATUS_RANK.items(), F.lit(none))
    h = mappings.select("instrument", "side", F.col("mapping_id").alias("supersedes"), *(F.col(c).alias(f"_{c}") for c in ("outcome_id", "polarity", "status", "equivalence", "rules")))
    x = incoming.join(h, ["instrument", "side"], "left")
    new, other = F.col("supersedes").isNull(), (F.col("outcome_id") != F.col("_outcome_id")) | (F.col("polarity") != F.col("_polarity"))
    weaker = rank("status", 0) <= rank("_status", 3)
    checked = F.col("_equivalence") != "pending"
    clash = checked & ~F.col("equivalence").isin("pending") & (F.col("equivalence") != F.col("_equivalence"))
    carried = checked & (F.col("rules").isNull() | F.col("rules").eqNullSafe(F.col("_rules")))
    action = ladder([(new, "insert"), (other, "conflict"), (weaker, "same"), (clash, "conflict")], "supersede")
    x = x.withColumn("action", action)
    up = (F.col("action") == "supersede") & carried
    note = F.when(up, F.concat("evidence", F.lit("; settlement "), "_equivalence", F.lit(" carried from mapping observation "), F.col("supersedes").cast("string")))
    note = note.when((F.col("action") == "supersede") & checked, F.concat("evidence", F.lit("; settlement "), "_equivalence", F.lit(" was checked against other rules: check again"))).otherwise(F.col("evidence"))
    return x.select(
        "instrument", "side", "outcome_id", "polarity", "status", F.when(up, F.col("_equivalence")).otherwise(F.col("equivalence")).alias("equivalence"),
        F.when(up, F.col("_rules")).otherwise(F.col("rules")).alias("rules"), note.alias("evidence"), F.when(F.col("action") == "supersede", F.col("supersedes")).alias("supersedes"), "action",
    )
