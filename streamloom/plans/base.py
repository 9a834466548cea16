"""Registration of queries with their SQL."""

from __future__ import annotations

QUERIES, SQL = {}, {}

#: The message view of streamloom.model in SQL.
M = """with m as (
  select event_id as seq, user_id as stream_id, event_type as kind, epoch_us(ts) as pts_us,
    epoch_us(ts) + ((event_id * 2654435761) % 600) * 1000000 as arrival_us,
    cast(round(value * 100) as bigint) as cents, cast(props->>'$.k' as int) as k,
    event_type = 'purchase' as is_sync, event_type = 'error' as is_disc
  from events)
"""


#: The same as a table of a recursive statement; oracles of folds go from row to row of a key with it.
RM = "with recursive " + M.strip()[len("with ") :]


def q(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put
