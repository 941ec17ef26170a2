"""Intermediate tables in the shared folder."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import DataFrame

from flowspark import session


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or ``path`` in it), read it back, and let go of what was shuffled for it.

    Spark deletes the shuffle files of finished work once the driver has collected the objects that
    stand for them. A long chain of steps would fill the disks before that happens by itself.
    """
    written = session.materialize(df, name, path)
    context = df.sparkSession.sparkContext
    # the end of the query is announced first, for its announcement holds the plan as well
    with suppress(Exception):
        context._jsc.sc().listenerBus().waitUntilEmpty(2000)
    context._jvm.System.gc()
    return written
