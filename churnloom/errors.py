"""Errors raised when an input cannot be processed."""


class CustomerDataError(ValueError):
    """Base class of every error this package raises."""


class IngestionError(CustomerDataError):
    """The source is missing, unreadable or holds no rows."""


class SchemaValidationError(CustomerDataError):
    """The table breaks the column contract."""


class ImputationError(CustomerDataError):
    """An unknown imputation strategy was asked for."""


class FeatureEngineeringError(CustomerDataError):
    """A derived feature cannot be built."""


class KPICalculationError(CustomerDataError):
    """A score, segment or indicator lacks its inputs."""


class ModelTrainingError(CustomerDataError):
    """Training cannot start."""


class ModelInferenceError(CustomerDataError):
    """Scoring or explaining cannot start."""


def require_columns(df, columns, error, purpose):
    """Raise ``error`` naming every absent column; schema only, no job runs."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise error(f"{purpose} needs column(s) {', '.join(absent)}")
