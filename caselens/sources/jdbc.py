"""Connection options for a PostgreSQL database, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping

# Variable names and their defaults.
DEFAULTS = {
    "DB_HOST": "localhost",
    "DB_PORT": "5432",
    "DB_NAME": "hospital_rag",
    "DB_USER": "postgres",
    "DB_PASSWORD": "",
}


def jdbc_options(
    table: str,
    environment: Mapping[str, str] | None = None,
    *,
    split_on: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")`` and ``df.write.format("jdbc")``.

    Give ``split_on`` (a numeric or date column), ``bounds`` and ``partitions`` to read
    with several connections; without them one task reads the whole table.
    """
    environment = os.environ if environment is None else environment
    setting = {name: environment.get(name, default) for name, default in DEFAULTS.items()}
    options = {
        "url": f"jdbc:postgresql://{setting['DB_HOST']}:{setting['DB_PORT']}/{setting['DB_NAME']}",
        "user": setting["DB_USER"],
        "password": setting["DB_PASSWORD"],
        "driver": "org.postgresql.Driver",
        "dbtable": table,
        "fetchsize": "10000",
    }
    if split_on:
        low, high = bounds
        options |= {
            "partitionColumn": split_on,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return options
