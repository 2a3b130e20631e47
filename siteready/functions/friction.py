"""Predicates over one logged step. A step is a flat row; see ``siteready.schema.STEPS`` for its columns.

``role_recorded`` tells an absent role from a recorded null one, ``new_document_recorded`` and
``first_request_recorded`` do the same for their columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteready.dims import constants as K


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def pilot() -> Column:
    return F.col("source").isNull()


def executed() -> Column:
    return pilot() & F.col("operation").isin(*K.EXECUTED) & ~_flag("stale") & ~_flag("guard_blocked")


def interaction() -> Column:
    return executed() & F.col("operation").isin(*K.INTERACTIONS)


def between_steps() -> Column:
    return F.col("operation") == "NAVIGATION"


def countable_click() -> Column:
    role = ~F.col("role_recorded") | F.coalesce(F.col("role").isin(*K.DEAD_ROLES), F.lit(False))
    return interaction() & (F.col("operation") == "CLICK") & role


def measured() -> Column:
    return _flag("since_available")


def effect() -> Column:
    """True, false or null (not measured): did the step have visible feedback?"""
    moved = _flag("new_tab") | _flag("external_nav") | _flag("navigation_error")
    counted = measured()
    answered = (_count("mutations") > 0) | (_count("navigations") > 0) | (F.coalesce("shifts_post_input", F.lit(0.0)) > 0)
    styled = F.col("page_changed").eqNullSafe(F.lit(True)) & F.col("mutations_total").eqNullSafe(F.lit(0))
    return (F.when(moved | (counted & answered) | (counted & styled), F.lit(True))
            .when(counted & F.col("state_changed").isNotNull(), F.col("state_changed"))
            .otherwise(F.col("page_changed")))


def no_effect() -> Column:
    return effect().eqNullSafe(F.lit(False))


def is_dead_click() -> Column:
    return countable_click() & no_effect()


def new_document() -> Column:
    guessed = (_count("navigations") > 0) & ~F.col("url_after").eqNullSafe(F.col("url_before"))
    return F.when(F.col("new_document_recorded"), _flag("new_document")).otherwise(guessed)


def visible_response() -> Column:
    """First response of a step that mutated the page or navigated; a request alone is no response."""
    return F.when((_count("mutations") > 0) | (_count("navigations") > 0), F.col("first_response_ms").cast("double"))


def request_inclusive() -> Column:
    return ~F.col("first_request_recorded") & (_count("requests") > 0)


def unexpected_nav() -> Column:
    late = between_steps() & _flag("follows_timeout")
    unasked = ~F.coalesce(F.col("operation").isin("CLICK", "SELECT"), F.lit(False)) & (
        new_document() | _flag("external_nav"))
    return ~late & (_flag("new_tab") | unasked)
