"""Feature chain (G1-G4, S11): amount -> balance -> behaviour -> time -> risk.

``fit`` learns both amount thresholds in one pass of the exact-quantile job.
``transform`` is lazy. Window stages are planned first over the raw columns
and the row-local stages are fused into one projection above them, so the
two shuffles carry only the raw row, never the 40 derived columns. The
result and its column order equal running the stages one after another.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from .. import errors as E
from .. import schema as S
from ..operators.behavior import BehaviorFeatures
from ..operators.quantile import exact_quantiles
from ..operators.stages import AmountFeatures, BalanceFeatures, RiskFeatures, TimeFeatures


class _CallableStage:
    """Adapter for user stages: a function or a pyspark.ml Transformer."""

    row_local = False  # opaque: never moved

    def __init__(self, fn, name: str | None = None):
        self.fn = fn
        self.name = name or getattr(fn, "__name__", None) or type(fn).__name__

    def transform(self, df: DataFrame) -> DataFrame:
        if hasattr(self.fn, "transform"):
            return self.fn.transform(df)
        return self.fn(df)


class FeatureChain:
    """Registry of feature stages with fitted thresholds."""

    def __init__(self, risk_large_txn_threshold: float | None = None,
                 amount_high_value_threshold: float | None = None,
                 amount_high_value_percentile: float = S.DEFAULT_QUANTILE,
                 behavior_mode: str = "auto", behavior_ranges: int | None = None,
                 balance_precision: str = "float"):
        self.amount = AmountFeatures(amount_high_value_percentile, amount_high_value_threshold)
        self.risk = RiskFeatures(risk_large_txn_threshold)
        self.stages: list = [
            self.amount,
            BalanceFeatures(balance_precision),
            BehaviorFeatures(behavior_mode, behavior_ranges),
            TimeFeatures(),
            self.risk,
        ]
        self.own = tuple(self.stages)

    # ---------------------------------------------------------------- fit ---
    def fit(self, reference: DataFrame, quantile: float = S.DEFAULT_QUANTILE) -> "FeatureChain":
        """Both thresholds from one exact-quantile job (amount stays at its own percentile)."""
        self.risk.check(reference)
        qs = [self.amount.high_value_percentile, quantile]
        stats: dict = {}
        amount_t, risk_t = exact_quantiles(reference, S.AMOUNT, qs, stats=stats)
        # a frame of at most hot_key_rows rows cannot hold a hot account; remember
        # its size so transforming this same frame needs no skew probe
        self._fitted_on, self._fitted_rows = reference, stats.get("rows")
        self.amount.high_value_threshold = amount_t
        self.risk.large_txn_threshold = risk_t
        return self

    @property
    def is_fitted(self) -> bool:
        return self.amount.high_value_threshold is not None and self.risk.large_txn_threshold is not None

    # ---------------------------------------------------------- transform ---
    def transform(self, df: DataFrame, sort: bool = False) -> DataFrame:
        """All features; ``sort=True`` also returns rows ordered by ``(step, row_id)``
        as the original does (W0) -- a range-partitioned global sort, so a step
        holding many rows is split by ``row_id`` across tasks."""
        out = self._transform(df)
        return out.orderBy(S.STEP, S.ROW_ID) if sort else out

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.risk.large_txn_threshold is None:
            raise E.FeatureRegistryError(
                "The chain does not know which amounts are large for RiskFeatures: fit() it, "
                "or give risk_large_txn_threshold.")
        if self.amount.high_value_threshold is None:
            raise E.FeatureRegistryError("The chain does not know which amounts are high for AmountFeatures: fit() it.")
        # Row-local stages are deferred and applied, in their order, after the
        # window stages (which read raw columns only); stages of users flush
        # the deferred ones first. Column order = running stages in sequence.
        out = df
        deferred: list = []
        order: list[str] = list(df.columns)
        for stage in self.stages:
            if stage is self.risk:
                missing = [c for c in S.RISK_DEPENDENCIES if c not in order]
                if missing:
                    absent = ", ".join(f"{c} (made by {S.RISK_DEPENDENCIES[c]})" for c in missing)
                    raise E.FeatureRegistryError(f"RiskFeatures reads columns that no stage before it made: {absent}")
            try:
                if stage not in self.own:  # a user's stage may read whatever stands before it
                    out, deferred = stage.transform(_apply(out, deferred)), []
                elif getattr(stage, "row_local", False):
                    if stage is not self.risk:
                        stage.check(out)
                    deferred.append(stage)
                elif isinstance(stage, BehaviorFeatures) and out is getattr(self, "_fitted_on", None):
                    out = stage.transform(out, rows_hint=self._fitted_rows)
                else:
                    out = stage.transform(out)
            except Exception as exc:  # analysis errors included: name the stage
                raise E.FeatureRegistryError(f"Feature generator '{_name(stage)}' failed: {exc}") from exc
            outs = getattr(stage, "outputs", None)
            if outs is None:
                order = _merge_order(order, out.columns)
            else:
                order = [c for c in order if c not in outs] + list(outs)
        try:
            out = _apply(out, deferred)
        except Exception as exc:
            raise E.FeatureRegistryError(f"Feature generator failed: {exc}") from exc
        return out.select(*[c for c in order if c in out.columns],
                          *[c for c in out.columns if c not in order])

    def fit_transform(self, df: DataFrame, quantile: float = S.DEFAULT_QUANTILE) -> DataFrame:
        return self.fit(df, quantile).transform(df)

    # ------------------------------------------------------------ registry ---
    def register(self, stage, before_risk: bool = True, name: str | None = None) -> None:
        """Add a stage (callable DataFrame -> DataFrame or pyspark.ml Transformer)."""
        wrapped = stage if hasattr(stage, "outputs") and hasattr(stage, "check") else _CallableStage(stage, name)
        if before_risk:
            self.stages.insert(self.stages.index(self.risk), wrapped)
        else:
            self.stages.append(wrapped)

    def list_stages(self) -> list[str]:
        return [_name(s) for s in self.stages]

    @property
    def feature_generators(self) -> list[str]:
        return self.list_stages()

    # --------------------------------------------------------- persistence ---
    def get_params(self) -> dict:
        """Both fitted thresholds (restores a fully fitted chain)."""
        return {
            "risk_large_txn_threshold": self.risk.large_txn_threshold,
            "amount_high_value_threshold": self.amount.high_value_threshold,
            "amount_high_value_percentile": self.amount.high_value_percentile,
        }

    @classmethod
    def from_params(cls, params: dict, **kwargs) -> "FeatureChain":
        return cls(**params, **kwargs)

    def save_params(self, path: str, spark=None) -> None:
        """Write both thresholds as JSON (through Spark for cluster storage)."""
        text = json.dumps(self.get_params())
        if spark is None:
            with open(path, "w") as fh:
                fh.write(text)
            return
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load_params(cls, path: str, spark=None, **kwargs) -> "FeatureChain":
        if spark is None:
            with open(path) as fh:
                return cls.from_params(json.load(fh), **kwargs)
        return cls.from_params(json.loads(spark.read.text(path).first()["value"]), **kwargs)


def _apply(df: DataFrame, stages: list) -> DataFrame:
    for st in stages:
        df = st.transform(df)
    return df


def _name(stage) -> str:
    return getattr(stage, "name", type(stage).__name__)


def _merge_order(order: list[str], cols: list[str]) -> list[str]:
    return [c for c in order if c in cols] + [c for c in cols if c not in order]
