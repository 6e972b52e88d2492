"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from .standin import FRAMES_SQL, Frames


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Frames], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return comparable(self.build(Frames(tune(spark), folder)))


REGISTRY: dict[str, Query] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that both engines print them alike."""
    shown = []
    for name, kind in df.dtypes:
        if kind == "date":
            shown.append(F.date_format(name, "yyyy-MM-dd").alias(name))
        elif kind.startswith("timestamp"):
            shown.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        else:
            shown.append(F.col(name))
    return df.select(*shown)


def query(name: str, covers: str, sql: str | None = None):
    """Register a query. ``sql`` may read the stand-in frames by name; they are put before it as WITH terms."""

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, None if sql is None else with_frames(sql))
        return build

    return register


def with_frames(sql: str) -> str:
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    used = _used(body)
    if not used:
        return body
    head = ",\n".join(f"{n} AS ({FRAMES_SQL[n]})" for n in used)
    if recursive:
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:].lstrip()}"
    return f"WITH {head}\n{body}"


def _used(body: str) -> list[str]:
    import re

    words = set(re.findall(r"\w+", body))
    wanted = {n for n in FRAMES_SQL if n in words}
    for _ in range(5):
        for n in list(wanted):
            wanted |= {m for m in FRAMES_SQL if m in set(re.findall(r"\w+", FRAMES_SQL[n]))}
    return [n for n in FRAMES_SQL if n in wanted]
