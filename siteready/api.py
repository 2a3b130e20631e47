"""Extension surface: register KPIs, risk tests and oracles; call operators as table functions from SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession

from siteready.dims.catalog import Catalog, Kpi, check_parity
from siteready.operators import checks, friction, scoring


class Engine:
    """A catalog plus what users registered on it."""

    def __init__(self, catalog: Catalog):
        self.catalog = replace(catalog, kpis=dict(catalog.kpis))
        self.page_checks: dict[str, tuple[str, Callable[[], Column], Callable[[], Column]]] = {}
        self.risk_tests: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.oracles: dict[str, tuple[dict, Callable[..., DataFrame]]] = {}

    def register_kpi(self, kpi: Kpi, value: Callable[[], Column], reason: Callable[[], Column]) -> None:
        """A page KPI: its registry entry and the columns that measure it (null value: the reason says why)."""
        self.catalog.kpis[kpi.id] = kpi
        check_parity(self.catalog)
        kind = {"number": "number", "bool": "bool"}.get(kpi.value_type, "enum")
        self.page_checks[kpi.id] = (kind, value, reason)

    def register_risk(self, kpi: Kpi, test: Callable[[DataFrame], DataFrame]) -> None:
        self.catalog.kpis[kpi.id] = kpi
        check_parity(self.catalog)
        self.risk_tests[kpi.id] = test

    def register_oracle(self, name: str, spec: dict, fn: Callable[..., DataFrame]) -> None:
        self.oracles[name] = (spec, fn)

    def page_kpis(self, pages: DataFrame) -> DataFrame:
        extra = {k: (kind, value(), reason()) for k, (kind, value, reason) in self.page_checks.items()}
        return checks.page_kpis(pages, self.catalog, extra)

    def score(self, observations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
        return scoring.score_runs(observations, self.catalog, extra)

    def verify(self, name: str, params: dict, *tables: DataFrame) -> DataFrame:
        if name not in self.oracles:
            raise ValueError(f"unknown oracle {name!r}; use one of {sorted(self.oracles)}")
        spec, fn = self.oracles[name]
        return fn(*tables, **check_params(spec, params))


# Fixed parameter specs of the outcome oracles: name -> parameter -> (required, kind).
ORACLE_PARAMS = {
    "cart_contains_item_under_price": {"max_price": (True, "number")},
    "cart_not_empty": {},
    "pdp_reached": {"query": (False, "text"), "max_price": (False, "number")},
    "search_results_shown": {"query": (False, "text")},
}


def check_params(spec: dict, params: dict | None) -> dict:
    """Validated literal parameters; decimal commas are read in number texts."""
    params = {k: v for k, v in (params or {}).items() if v is not None}
    unknown = sorted(set(params) - set(spec))
    if unknown:
        raise ValueError(f"unknown parameter {unknown[0]!r}")
    for key, (required, kind) in spec.items():
        if key not in params:
            if required:
                raise ValueError(f"parameter {key} is required")
            continue
        value = params[key]
        if kind == "number":
            try:
                value = float(str(value).strip().replace(",", ".")) if not isinstance(value, bool) else float("nan")
            except ValueError:
                value = float("nan")
            if not 0 < value < float("inf"):
                raise ValueError(f"{key} must be a positive number")
            params[key] = value
        elif not isinstance(value, str) or not value.strip() or len(value) > 200:
            raise ValueError(f"{key} must be a short non-empty text")
    return params


def check_param_table(params: DataFrame) -> DataFrame:
    """The same rules for a table of journeys: problem is null for valid rows. params: run_id, oracle, name, value."""
    from pyspark.sql import functions as F
    known = [(o, p, kind) for o, spec in ORACLE_PARAMS.items() for p, (_, kind) in spec.items()]
    dim = params.sparkSession.createDataFrame(known, "oracle string, name string, kind string")
    names = params.join(F.broadcast(dim), ["oracle", "name"], "left")
    number = F.replace(F.trim("value"), F.lit(","), F.lit(".")).try_cast("double")
    bad = (F.when(~F.col("oracle").isin(*ORACLE_PARAMS), "unknown_oracle").when(F.col("kind").isNull(), "unknown_parameter")
           .when((F.col("kind") == "number") & ~F.coalesce((number > 0) & (number < float("inf")), F.lit(False)), "not_a_positive_number")
           .when((F.col("kind") == "text") & ((F.trim("value") == "") | (F.length("value") > 200)), "not_a_short_text"))
    return names.withColumn("problem", bad).drop("kind")


def register_views(spark: SparkSession, steps: DataFrame, journeys: DataFrame) -> None:
    """Friction operators as views SQL callers can join: visits, rage, friction."""
    friction.visits(steps).createOrReplaceTempView("siteready_visits")
    friction.rage(steps).createOrReplaceTempView("siteready_rage")
    friction.metrics(steps, journeys).createOrReplaceTempView("siteready_friction")
