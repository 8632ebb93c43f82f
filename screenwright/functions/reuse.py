"""Expressions that are built once and used in many frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession


def built_once(build: Callable) -> Callable:
    """Keep what ``build`` returns, per Spark application and arguments.

    Building the expressions of a detector takes thousands of calls into the JVM. They name their inputs, so they hold
    for every frame that has columns of these names. Arguments have to be hashable.
    """
    kept: WeakKeyDictionary = WeakKeyDictionary()

    @wraps(build)
    def get(*args):
        mine = kept.setdefault(SparkSession.active().sparkContext, {})
        if args not in mine:
            mine[args] = build(*args)
        return mine[args]

    return get
