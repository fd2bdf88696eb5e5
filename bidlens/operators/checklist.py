"""Action checklists and outreach drafts from a notice's own fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.normalize import days_left, set_aside_label
from ..functions.text import non_empty

_ITEM = ("action", "detail", "due", "priority", "source")


def _item(action, detail, due, priority, source) -> Column:
    values = [x if isinstance(x, Column) else F.lit(x) for x in (action, detail, due, priority, source)]
    return F.struct(*[v.cast("string").alias(n) for v, n in zip(values, _ITEM)])


def playbook_code(kind: Column) -> Column:
    """The type code of a code or, regardless of case, a label."""
    by_label = F.create_map(*[F.lit(x) for code, label in V.NOTICE_TYPES.items() for x in (label.lower(), code)])
    return F.coalesce(F.try_element_at(by_label, F.lower(kind)), F.when(kind.isin(*V.NOTICE_TYPES), kind))


def checklist(notices: DataFrame, as_of: Column, key: str = "notice_id") -> DataFrame:
    """key, position and item of each notice's checklist: deadline, playbook of the type, set-aside, what always holds.

    Every list is built within its row; the playbook is a constant of the expression.
    """
    days = days_left(F.col("deadline").cast("timestamp"), as_of)
    at = F.date_format(F.col("deadline").cast("timestamp"), "yyyy-MM-dd HH:mm")
    late = days < 0
    due = _item(
        F.when(late, V.DEADLINE_PASSED).otherwise(V.DEADLINE_AHEAD),
        F.concat(F.lit("Response deadline: "), at, F.lit(". ~"), days.cast("string"), F.lit(" day(s) remaining.")),
        F.date_format("deadline", "yyyy-MM-dd"),
        F.when(late | (days <= 7), "high").otherwise("normal"),
        "opportunity metadata: responseDeadLine",
    )
    review = _item(*V.REVIEW, F.date_format(F.date_sub(F.col("deadline").cast("date"), 2), "yyyy-MM-dd"), "normal", "rules engine (derived from responseDeadLine)")
    source = F.concat(F.lit("notice type: "), F.coalesce(non_empty(F.col("type")), F.lit("unknown")))
    code = playbook_code(F.col("type"))
    none = F.slice(F.array(due), 2, 0)
    plays = none
    for c, items in V.PLAYBOOK.items():
        plays = F.when(code == c, F.array(*[_item(a, d, None, p, source) for a, d, p in items])).otherwise(plays)
    restricted = set_aside_label(non_empty(F.col("set_aside")))
    aside = _item(V.SET_ASIDE_CHECK, F.concat(F.lit("This is restricted to: "), restricted, F.lit(". Verify your firm qualifies before investing effort.")), None, "high", "opportunity metadata: typeOfSetAside")
    tail = F.array(*[_item(a, d, None, p, "rules engine") for a, d, p in V.PLAYBOOK_TAIL])
    dated = F.col("deadline").isNotNull()
    items = F.concat(F.when(dated, F.array(due)).otherwise(none), F.when(dated & (days > 2), F.array(review)).otherwise(none), plays, F.when(restricted.isNotNull(), F.array(aside)).otherwise(none), tail)
    return notices.select(key, F.posexplode(items).alias("position", "i")).select(key, "position", "i.*")


def outreach(notices: DataFrame, profile: dict[str, str]) -> DataFrame:
    """notice_id, subject, body and sources of a letter of introduction. profile: company, capabilities, sender."""
    naics = F.when(non_empty(F.col("naics")).isNotNull(), F.concat(F.lit(" (NAICS "), F.col("naics"), F.lit(")"))).otherwise("")
    noted = F.when(F.col("deadline").isNotNull(), F.concat(F.lit("We note the response deadline of "), F.date_format("deadline", "MMMM dd, yyyy"), F.lit(". "))).otherwise("")
    title = F.coalesce(non_empty(F.col("title")), F.col("notice_id"))
    body = F.concat(
        F.lit("Dear Contracting Officer,\n\nI am writing for "), F.lit(profile["company"]), F.lit(' about "'), title, F.lit('" ('), F.col("notice_id"), F.lit("), posted by "),
        F.coalesce(non_empty(F.col("agency")), F.lit("your agency")), naics, F.lit(".\n\n"), F.lit(profile["company"]), F.lit(" specializes in "), F.lit(profile["capabilities"]), F.lit(". "), noted,
        F.lit("Please tell us how responses are to be submitted and whether amendments are expected.\n\nBest regards,\n"), F.lit(profile["sender"]),
    )
    sources = F.filter(F.array(F.lit("metadata: title, number, agency"), F.when(non_empty(F.col("naics")).isNotNull(), "metadata: naics"), F.when(F.col("deadline").isNotNull(), "metadata: deadline")), lambda s: s.isNotNull())
    return notices.select("notice_id", F.concat(F.lit("Inquiry: "), title).alias("subject"), body.alias("body"), F.array_join(sources, "; ").alias("sources"))
