"""Player availability at a decision time, from reports that arrive late and may be retracted.

A report is visible once both its own time and its retrieval have passed. Decisions
are (player, as_of) rows; everything is an as-of aggregate over the moment a report
becomes visible, so no decision is paired with all reports of its player.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.functions.expr import hours_after, hours_before
from gridcast.operators.asof import asof_aggregate, timeline
from gridcast.session import stage

_HOURS = K.CORROBORATION_HOURS


def status_of_text(report_class: Column, text: Column) -> Column:
    """Availability status a report's words stand for; null when they are not recognized."""
    table = F.create_map(
        *chain.from_iterable((F.lit(f"{c}|{t}"), F.lit(s)) for c, by_text in K.STATUS_TEXT.items() for t, s in by_text.items())
    )
    words = F.lower(F.trim(text))
    doubt = words.contains("question") | words.contains("doubt")
    in_game = (
        F.when(words.contains("return") & ~doubt, "returned")
        .when(words.contains("left") | words.contains("exit"), "left_game")
        .otherwise("tentative")
    )
    return F.when(report_class == "in_game_incident", in_game).otherwise(
        F.try_element_at(table, F.concat(report_class, F.lit("|"), words))
    )


def live_reports(reports: DataFrame) -> DataFrame:
    """Reports that were not retracted, with the moment they become visible and their mapped status."""
    return reports.filter(F.col("correction_state") != "retracted").withColumn(
        "visible_at", F.greatest("event_time", "retrieved_at")
    ).withColumn("status", status_of_text(F.col("report_class"), F.col("status_text")))


def visible_reports(decisions: DataFrame, reports: DataFrame) -> DataFrame:
    """The reports each decision may look at (an explicit listing; retracted ones included)."""
    seen = F.greatest("event_time", "retrieved_at")
    return decisions.join(reports, "player_id").filter(seen <= F.col("as_of"))


def report_positions(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Place 1, 2, ... of every report in the order in which the reports of its ``keys`` become visible, ties by report_id.

    What a decision may look at is a prefix of that order. So one number per decision (``visible_prefix``, or ``reports`` of
    :func:`resolve_availability`) and one row per report say the same as a list per decision, and both grow with their input only.
    No task ranks a whole hot key: the places are those of the instant, from the two-level totals, plus the rank at that instant.
    """
    before = timeline(reports, keys, "visible_at", {"seen": ("sum", F.lit(1).cast("bigint"))}).select(*keys, "visible_at", "before_seen")
    tied = Window.partitionBy(*keys, "visible_at").orderBy("report_id")
    ranked = reports.select(*keys, "visible_at", "report_id", F.row_number().over(tied).alias("_rank"))
    return ranked.join(before, [*keys, "visible_at"]).select(
        *keys, "report_id", "visible_at", (F.col("before_seen") + F.col("_rank")).alias("position")
    )


def visible_prefix(decisions: DataFrame, reports: DataFrame) -> DataFrame:
    """How many reports of its player, retracted ones included, each decision may look at: the prefix of their positions."""
    return asof_aggregate(
        decisions, reports.withColumn("visible_at", F.greatest("event_time", "retrieved_at")), ["player_id"], "visible_at",
        {"reports": ("sum", F.lit(1).cast("bigint"))}, probe_ts="as_of", inclusive=True,
    )


def contributing_reports(resolved: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per decision of :func:`resolve_availability` and report behind it: the prefix written out."""
    placed = report_positions(live_reports(reports), ["player_id", "report_class"])
    asked = resolved.filter(F.col("reports") > 0).select("player_id", "as_of", "report_class", "reports")
    return asked.join(placed, ["player_id", "report_class"]).filter(F.col("position") <= F.col("reports")).select(
        "player_id", "as_of", "report_class", "report_id", "position"
    )


def with_report_ids(resolved: DataFrame, reports: DataFrame) -> DataFrame:
    """``resolved`` with ``report_ids``, the sorted ids of the contributing reports; empty without any."""
    listed = contributing_reports(resolved, reports).groupBy("player_id", "as_of").agg(F.array_sort(F.collect_list("report_id")).alias("report_ids"))
    nothing = F.array().cast(listed.schema["report_ids"].dataType)
    return resolved.join(listed, ["player_id", "as_of"], "left").withColumn("report_ids", F.coalesce("report_ids", nothing))


def _slot(ts: Column) -> Column:
    """Number of the two-hour slot a time falls into."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.floor(seconds / F.lit(3600 * _HOURS)).cast("bigint")


def corroborated_at(reports: DataFrame, keys: list[str]) -> DataFrame:
    """For every report, the moment a second source within two hours of it became visible.

    ``reports`` needs report_id, source, event_time and visible_at. A report is
    corroborated by any visible report of another source at most two hours apart.
    With slots as wide as the window, that window is the tail of the previous slot,
    the whole own slot and the head of the next one. So each report asks its two
    neighbouring slots once, and running windows inside a slot answer for the best
    two sources (earliest visible, and earliest visible of any other source). Every
    row is touched a fixed number of times however dense the reports are.
    """
    rows = reports.select(*keys, "report_id", "source", "event_time", "visible_at")
    facts = rows.select(
        *keys, _slot(F.col("event_time")).alias("_slot"), F.col("event_time").alias("_at"),
        F.struct(F.col("visible_at").alias("v"), F.col("source").alias("s")).alias("_seen"),
        F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["report_id"].dataType).alias("report_id"),
        F.lit(None).cast("string").alias("_own"),
    )

    def ask(slot: Column, at: Column, kind: int) -> DataFrame:
        return rows.select(
            *keys, slot.alias("_slot"), at.alias("_at"),
            F.lit(None).cast(facts.schema["_seen"].dataType).alias("_seen"), F.lit(kind).alias("_kind"),
            "report_id", F.col("source").cast("string").alias("_own"),
        )

    own = _slot(F.col("event_time"))
    # kind 0 asks for everything from its time on, kind 2 for everything up to it, kind 3 for the whole slot
    tail = ask(own - 1, hours_before(F.col("event_time"), _HOURS), 0)
    head = ask(own + 1, hours_after(F.col("event_time"), _HOURS), 2)
    whole = ask(own, F.col("event_time"), 3)
    everything = facts.unionByName(tail).unionByName(head).unionByName(whole)

    slot = Window.partitionBy(*keys, "_slot")
    upward = slot.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    downward = slot.orderBy(F.col("_at").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upward_before = slot.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    downward_before = slot.orderBy(F.col("_at").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def runner_up(best: str, before: str) -> Column:
        """What this row adds to the race for the earliest report of any source but the best one's."""
        change = F.col(before).isNotNull() & (F.col(before)["s"] != F.col(best)["s"])
        return F.when(change, F.col(before)["v"]).when(
            F.col("_seen").isNotNull() & (F.col("_seen")["s"] != F.col(best)["s"]), F.col("_seen")["v"]
        )

    best = everything.select(
        "*",
        F.min("_seen").over(upward).alias("_up"), F.min("_seen").over(upward_before).alias("_up_before"),
        F.min("_seen").over(downward).alias("_down"), F.min("_seen").over(downward_before).alias("_down_before"),
        F.min("_seen").over(slot).alias("_all"),
    )
    second = best.withColumn("_up_next", runner_up("_up", "_up_before")).withColumn(
        "_down_next", runner_up("_down", "_down_before")
    ).withColumn("_all_next", F.when(F.col("_seen")["s"] != F.col("_all")["s"], F.col("_seen")["v"]))
    answered = second.select(
        *keys, "report_id", "_own", "_kind", "_up", "_down", "_all",
        F.min("_up_next").over(upward).alias("_up2"),
        F.min("_down_next").over(downward).alias("_down2"),
        F.min("_all_next").over(slot).alias("_all2"),
    ).filter(F.col("_kind") != 1)

    def other(best: str, next_best: str) -> Column:
        return F.when(F.col(best)["s"] != F.col("_own"), F.col(best)["v"]).otherwise(F.col(next_best))

    part = (
        F.when(F.col("_kind") == 0, other("_down", "_down2"))
        .when(F.col("_kind") == 2, other("_up", "_up2"))
        .otherwise(other("_all", "_all2"))
    )
    partner = answered.groupBy(*keys, "report_id").agg(F.min(part).alias("_partner_at"))
    return (
        rows.join(partner.filter(F.col("_partner_at").isNotNull()), [*keys, "report_id"])
        .withColumn("corroborated_at", F.greatest("visible_at", "_partner_at"))
        .drop("_partner_at")
    )


def _latest_near_anchor(anchored: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Latest visible report time within two hours of each decision's anchor."""
    anchors = anchored.select(*keys, "anchor").distinct()
    near = (
        anchors.withColumn("_slot", F.explode(F.sequence(_slot(F.col("anchor")) - 1, _slot(F.col("anchor")) + 1)))
        .join(reports.select(*keys, "event_time", "visible_at", _slot(F.col("event_time")).alias("_slot")), [*keys, "_slot"])
        .filter(F.col("event_time").between(hours_before(F.col("anchor"), _HOURS), hours_after(F.col("anchor"), _HOURS)))
    )
    return asof_aggregate(
        anchored, near, [*keys, "anchor"], "visible_at", {"latest": ("max", F.col("event_time"))}, probe_ts="as_of", inclusive=True
    )


def confirmation(decisions: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmation of what is known per decision: confirmed, stale, or tentative.

    ``reports`` are live reports with an ``official`` flag; ``decisions`` carry the
    keys and ``as_of``. An official report settles it alone. Otherwise the earliest
    report with a second source within two hours decides, also when a later pair
    would be fresher. A settled status older than a day is stale.
    """
    asked = decisions.select(*keys, "as_of").distinct()
    official = asof_aggregate(
        asked, reports.filter("official"), keys, "visible_at", {"official_latest": ("max", F.col("event_time"))},
        probe_ts="as_of", inclusive=True,
    )
    unofficial = reports.filter(~F.col("official"))
    first = asof_aggregate(
        asked, corroborated_at(unofficial, keys), keys, "corroborated_at", {"anchor": ("min", F.col("event_time"))},
        probe_ts="as_of", inclusive=True,
    )
    first = stage(first)
    latest = _latest_near_anchor(first.filter(F.col("anchor").isNotNull()), unofficial, keys)
    known = official.join(first, [*keys, "as_of"], "left").join(latest, [*keys, "anchor", "as_of"], "left")
    basis = F.coalesce("official_latest", "latest")
    return known.withColumn(
        "confirmation",
        F.when(basis.isNull(), "tentative")
        .when(hours_after(basis, K.MAX_CONFIRMED_AGE_HOURS) < F.col("as_of"), "stale")
        .otherwise("confirmed"),
    ).withColumn("executable", F.col("confirmation") == "confirmed").select(*keys, "as_of", "confirmation", "executable")


def with_official(reports: DataFrame) -> DataFrame:
    return live_reports(reports).withColumn("official", F.col("report_class").isin(*K.OFFICIAL_CLASSES))


def confirm_players(decisions: DataFrame, reports: DataFrame) -> DataFrame:
    """Confirmation over all report classes of a player."""
    return confirmation(decisions, with_official(reports), ["player_id"])


def resolve_availability(decisions: DataFrame, reports: DataFrame) -> DataFrame:
    """Status, confirmation and reason per (player, as_of).

    The most decisive class with a visible report is looked at alone. No recognized
    text, or texts that disagree, leave the status unknown; so does a stale
    confirmation. An uncorroborated status is only tentative.
    """
    live = stage(with_official(reports))
    bits = F.create_map(*chain.from_iterable((F.lit(s), F.lit(1 << i)) for i, s in enumerate(K.AVAILABILITY_STATUSES)))
    asked = stage(decisions.select("player_id", "as_of").distinct())
    per_class = asked.withColumn("report_class", F.explode(F.array(*[F.lit(c) for c in K.REPORT_CLASSES])))
    seen = asof_aggregate(
        per_class, live, ["player_id", "report_class"], "visible_at",
        {
            "reports": ("sum", F.lit(1).cast("bigint")),
            "statuses": ("or", F.coalesce(F.try_element_at(bits, F.col("status")), F.lit(0))),
        },
        probe_ts="as_of", inclusive=True,
    ).filter(F.col("reports") > 0)
    rank = F.array_position(F.array(*[F.lit(c) for c in K.REPORT_CLASSES]), F.col("report_class"))
    top = stage(
        seen.groupBy("player_id", "as_of")
        .agg(F.min_by(F.struct("report_class", "reports", "statuses"), rank).alias("_top"))
        .select("player_id", "as_of", "_top.*")
    )
    settled = confirmation(top, live, ["player_id", "report_class"])
    found = asked.join(top, ["player_id", "as_of"], "left").join(settled, ["player_id", "report_class", "as_of"], "left")
    names = F.array(*[F.lit(s) for s in K.AVAILABILITY_STATUSES])
    kinds = F.bit_count("statuses")
    single = F.get(names, F.log2(F.col("statuses").cast("double")).cast("int"))
    reason = (
        F.when(F.col("report_class").isNull(), "no visible report")
        .when(kinds == 0, "no recognized status")
        .when(kinds > 1, "conflicting statuses")
        .when(F.col("confirmation") == "stale", "stale")
        .when(F.col("confirmation") == "tentative", "not corroborated")
    )
    status = (
        F.when(reason.isNull(), single).when(reason == "not corroborated", "tentative").otherwise("unknown")
    )
    used = F.when(kinds == 1, F.col("confirmation"))
    return found.select(
        "player_id", "as_of", "report_class", F.coalesce("reports", F.lit(0)).alias("reports"),
        status.alias("status"), used.alias("confirmation"), reason.alias("reason"),
    )
