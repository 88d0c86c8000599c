"""A bitemporal analytics engine on Spark DataFrames."""

from .database import Database, Reads, Result, Transaction
from .errors import ModelRejected, OptimisticConflict, QueryRejected, StaleWrite, WriteRejected
from .model import Attribute, Entity, Inheritance, Model, Relationship, SortKey, ValueObject
from .query import Aggregate, AggregateQuery, Having, Include, Query
from .types import INFINITY

__all__ = [
    "INFINITY", "Aggregate", "AggregateQuery", "Attribute", "Database", "Entity", "Having", "Include", "Inheritance",
    "Model", "ModelRejected", "OptimisticConflict", "Query", "QueryRejected", "Reads", "Relationship", "Result", "SortKey",
    "StaleWrite", "Transaction", "ValueObject", "WriteRejected",
]
