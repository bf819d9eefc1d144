"""All queries of the engine by name, each with equivalent ANSI SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The moment that stands for now: the day after the last event.
AS_OF = "2024-01-31 00:00:00"

#: Views of the tables in the platform's shape, as the sources module makes them.
WITH = """WITH RECURSIVE rec AS (
    SELECT event_id AS id, user_id, ts AS created_at, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS question_id,
           event_type <> 'error' AS is_correct, value > 20 AS is_mastered, event_type = 'signup' AS removed_from_wrong, value
    FROM events),
que AS (
    SELECT p_partkey + 17 AS qid, p_brand AS bank_id, p_type AS subject, p_name AS content, p_size AS index_num, p_retailprice AS price
    FROM part),
both_ AS (SELECT rec.*, que.bank_id, que.subject FROM rec LEFT JOIN que ON question_id = qid),
raw_lines AS (
    SELECT doc_id AS page, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
    FROM documents),
lin AS (
    SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS INTEGER) AS line_no, trim(l) AS line,
           CAST((row_number() OVER (PARTITION BY page ORDER BY k) - 1) * 12 AS INTEGER) AS y0
    FROM raw_lines WHERE trim(l) <> '')
"""


def query(sql: str | None = None, prelude: bool = True):
    """Registers a function (spark, sf_dir) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (WITH if prelude else "") + sql
        return f

    return add


from gradeloom.plans import analytics, arrivals, cached, callbacks, golden_cases, linking, listings, page_batches, pages, regions, review, reviewed, scalars, scores  # noqa: E402, F401
