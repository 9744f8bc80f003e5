"""Exceptions. Messages are part of the interface."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of this package."""


class DataError(EngineError):
    pass


class InvalidCsvFormat(DataError):
    def __init__(self, message: str) -> None:
        super().__init__(f"Invalid CSV format: {message}")


class MissingColumn(DataError):
    def __init__(self, column: str) -> None:
        super().__init__(f"Missing required column: {column}")
        self.column = column


class InvalidDataType(DataError):
    def __init__(self, column: str, expected: str, actual: str) -> None:
        super().__init__(f"Invalid data type for column {column}: expected {expected}, got {actual}")
        self.column = column


class ValidationFailed(DataError):
    def __init__(self, message: str) -> None:
        super().__init__(f"Data validation failed: {message}")


class EmptyDataset(DataError):
    def __init__(self) -> None:
        super().__init__("Dataset is empty")


class InsufficientData(DataError):
    def __init__(self, min_points: int, actual_points: int) -> None:
        super().__init__(f"Insufficient data for clustering: need at least {min_points} points, got {actual_points}")


class InvalidBar(DataError):
    def __init__(self, message: str) -> None:
        super().__init__(f"Invalid OHLCV data: {message}")


class ConfigError(EngineError):
    def __init__(self, field: str, message: str) -> None:
        super().__init__(f"Configuration error: {field}: {message}")
        self.field = field


class ClusteringError(EngineError):
    pass


class TooManyPoints(ClusteringError):
    """For algorithms that keep a matrix of all pairs of a group."""
