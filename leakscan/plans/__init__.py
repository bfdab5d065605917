"""The registered queries, their inputs and their SQL counterparts."""

from __future__ import annotations

from leakscan.plans import detection, logs, policies, registry, streams  # noqa: F401

ZONE = "spark.sql.session.timeZone"


def queries() -> dict:
    return {name: _in_utc(fn) for name, fn in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def _in_utc(fn):
    """The test tables hold times without a zone; they are read as UTC.

    A plan keeps the zone it was made in, so the session gets its own back.
    """
    def run(spark, folder):
        zone = spark.conf.get(ZONE)
        spark.conf.set(ZONE, "UTC")
        try:
            return fn(spark, folder)
        finally:
            spark.conf.set(ZONE, zone)

    return run
