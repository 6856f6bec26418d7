"""Exceptions raised by the engine; one shared base."""

from __future__ import annotations


class TxRiskError(Exception):
    """Base of every error this package raises on purpose."""


class DataLoadError(TxRiskError):
    pass


class SchemaValidationError(TxRiskError):
    pass


class MissingColumnError(SchemaValidationError):
    pass


class InvalidDataTypeError(SchemaValidationError):
    pass


class EmptyDatasetError(SchemaValidationError):
    pass


class DataValidationError(TxRiskError):
    pass


class DataIntegrityError(TxRiskError):
    pass


class DataSplitError(TxRiskError):
    pass


class DataPersistenceError(TxRiskError):
    pass


class FeatureError(TxRiskError):
    """Base of per-stage feature errors."""


class AmountFeatureError(FeatureError):
    pass


class BalanceFeatureError(FeatureError):
    pass


class BehaviorFeatureError(FeatureError):
    pass


class TimeFeatureError(FeatureError):
    pass


class RiskFeatureError(FeatureError):
    pass


class FeatureRegistryError(TxRiskError):
    pass


class ModelFactoryError(TxRiskError):
    pass


class ModelTrainingError(TxRiskError):
    pass


class ModelPersistenceError(TxRiskError):
    pass


class EvaluationError(TxRiskError):
    pass


class MetricsError(EvaluationError):
    pass


class ConfusionMatrixError(EvaluationError):
    pass


class FeatureImportanceError(EvaluationError):
    pass


class ExplainerError(TxRiskError):
    pass
