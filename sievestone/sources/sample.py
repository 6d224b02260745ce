"""The driver's tables seen as ratings, movies and users, and as dirty text lines of them.

Each view is one SQL text that Spark and DuckDB read alike, so a query and its oracle start from the
same rows.  Dirt is dealt by the remainders of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievestone.session import table

_SPARK = {"seconds": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', l_shipdate)", "text": "STRING"}
_DUCK = {"seconds": "CAST(epoch(l_shipdate) AS BIGINT)", "text": "VARCHAR"}
_TABLES = ("lineitem", "orders", "part", "customer")

RATINGS = """
SELECT o_custkey + 1 AS user_id, l_partkey + 1 AS movie_id, CAST(1 + floor((l_quantity - 1) / 10) AS BIGINT) AS rating, {seconds} AS ts, l_orderkey * 10 + l_linenumber AS line_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

MOVIES = """
SELECT p_partkey + 1 AS movie_id, concat(p_name, ' (', CAST(1930 + p_partkey % 70 AS {text}), ')') AS title,
    concat(CASE p_type WHEN 'ECONOMY' THEN 'Drama' WHEN 'STANDARD' THEN 'Comedy' WHEN 'LARGE' THEN 'Action' WHEN 'PROMO' THEN 'Thriller' WHEN 'SMALL' THEN 'Romance' ELSE 'Film-Noir' END,
        CASE p_size % 4 WHEN 0 THEN '|War' WHEN 1 THEN '|Children''s' WHEN 2 THEN '|Sci-Fi' ELSE '' END) AS genres, p_partkey % 29 AS dirt
FROM {part}"""

USERS = """
SELECT c_custkey + 1 AS user_id, CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS gender,
    CASE c_custkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '18' WHEN 2 THEN '25' WHEN 3 THEN '35' WHEN 4 THEN '45' WHEN 5 THEN '50' ELSE '56' END AS age,
    CAST(c_nationkey % 21 AS {text}) AS occup, lpad(CAST((c_custkey * 37) % 100000 AS {text}), 5, '0') AS zipcode, c_custkey % 31 AS dirt
FROM {customer}"""

RATING_LINES = f"""
WITH s AS (SELECT *, line_id % 23 AS dirt, CAST(user_id AS {{text}}) AS u, CAST(movie_id AS {{text}}) AS m, CAST(rating AS {{text}}) AS r, CAST(ts AS {{text}}) AS t FROM ({RATINGS}) x)
SELECT CASE dirt WHEN 0 THEN concat(u, ',', m, ',', r, ',', t) WHEN 1 THEN concat(u, '::', m, '::', r, '::', t, '::EXTRA_FIELD') WHEN 2 THEN concat(u, '::', m, '::', r)
    WHEN 3 THEN concat(u, '::', m, '::five::', t) WHEN 4 THEN concat(u, '::', m, '::0::', t) WHEN 5 THEN concat(u, '::', m, '::6::', t) WHEN 6 THEN concat(u, '::', m, '::', r, '::', t, '000')
    WHEN 7 THEN concat(u, '::', m, '::', r, '::-', t) WHEN 8 THEN concat(CAST(user_id + 1000000 AS {{text}}), '::', m, '::', r, '::', t) WHEN 11 THEN concat(u, '::', m, '::', r, '::', t, '::')
    WHEN 12 THEN concat('0', u, '::', m, '::', r, '::', t) WHEN 13 THEN concat(u, ':', m, ':', r, ':', t) WHEN 14 THEN concat(u, '::', m, '::0', r, '::', t) WHEN 15 THEN concat('::', m, '::', r, '::', t)
    ELSE concat(u, '::', m, '::', r, '::', t) END AS line FROM s
UNION ALL SELECT concat(u, '::', m, '::', r, '::', t) AS line FROM s WHERE dirt = 6 OR dirt = 9
UNION ALL SELECT concat(u, '::', m, '::', CAST(rating % 5 + 1 AS {{text}}), '::', t) AS line FROM s WHERE dirt = 10"""

MOVIE_LINES = f"""
WITH s AS (SELECT *, CAST(movie_id AS {{text}}) AS m FROM ({MOVIES}) x)
SELECT CASE dirt WHEN 0 THEN concat(m, ':: ', title, ' ::', genres) WHEN 1 THEN concat(m, '::', title, '::UnknownGenre') WHEN 2 THEN concat(m, '::', title, '::') WHEN 3 THEN concat(m, '::', replace(title, '(', '['), '::', genres)
    WHEN 4 THEN concat(m, '::old (1850)::', genres) WHEN 5 THEN concat(m, ':: ::', genres) WHEN 6 THEN concat(m, ',', title, ',', genres) WHEN 7 THEN concat(m, '::', title, '::', genres, '::EXTRA_FIELD')
    WHEN 8 THEN concat(m, '::Misérable ', title, '::', genres) WHEN 11 THEN concat(CAST(movie_id + 1000000 AS {{text}}), '::', title, '::', genres) WHEN 12 THEN concat(m, '::', title, '::', genres, '|')
    WHEN 13 THEN concat(m, '::', title) WHEN 14 THEN concat(m, '::', title, '::Drama|War|Drama') WHEN 15 THEN concat(m, '|', title, '|', genres) ELSE concat(m, '::', title, '::', genres) END AS line FROM s
UNION ALL SELECT concat(m, '::other ', title, '::', genres) AS line FROM s WHERE dirt = 9
UNION ALL SELECT concat(m, '::', title, '::', genres) AS line FROM s WHERE dirt = 10"""

USER_LINES = f"""
WITH s AS (SELECT *, CAST(user_id AS {{text}}) AS u FROM ({USERS}) x)
SELECT CASE dirt WHEN 0 THEN concat(u, '::', gender, '::', age, '::', occup, '::', zipcode, '-1234') WHEN 1 THEN concat(u, '::X::', age, '::', occup, '::', zipcode) WHEN 2 THEN concat(u, '::', gender, '::99::', occup, '::', zipcode)
    WHEN 3 THEN concat(u, '::', gender, '::', age, '::21::', zipcode) WHEN 4 THEN concat(u, '::', gender, '::', age, '::', occup, '::ABCDE') WHEN 5 THEN concat(u, ':: ', gender, '::', age, '::', occup, '::', zipcode)
    WHEN 8 THEN concat(u, '|', gender, '|', age, '|', occup, '|', zipcode) WHEN 9 THEN concat(u, '::', gender, '::', age, '::', occup, '::', zipcode, '::EXTRA_FIELD::EXTRA_FIELD') WHEN 10 THEN concat(CAST(user_id + 1000000 AS {{text}}), '::', gender, '::', age, '::', occup, '::', zipcode)
    WHEN 11 THEN concat('::', gender, '::', age, '::', occup, '::', zipcode) WHEN 12 THEN concat(u, '::', gender, '::', age, '::', occup, '::') WHEN 13 THEN concat(u, '::', gender, '::', age) ELSE concat(u, '::', gender, '::', age, '::', occup, '::', zipcode) END AS line FROM s
UNION ALL SELECT concat(u, '::', gender, '::50::', occup, '::', zipcode) AS line FROM s WHERE dirt = 6
UNION ALL SELECT concat(u, '::', gender, '::', age, '::', occup, '::', zipcode) AS line FROM s WHERE dirt = 7"""



def one_pass(sql: str) -> str:
    """The lines for Spark: each row's first line and those that conditions add to it, from one pass over the rows."""
    head, rest = sql.split("\nSELECT CASE dirt", 1)
    first, *more = rest.split("\nUNION ALL SELECT ")
    lines = ["CASE dirt" + first.removesuffix(" AS line FROM s")]
    lines += [f"CASE WHEN {condition} THEN {line} END" for line, condition in (part.split(" AS line FROM s WHERE ") for part in more)]
    return f"{head}\nSELECT line FROM (SELECT explode(array({', '.join(lines)})) AS line FROM s) WHERE line IS NOT NULL"


LINES = {"ratings": RATING_LINES, "movies": MOVIE_LINES, "users": USER_LINES}
ROWS = {"ratings": RATINGS, "movies": MOVIES, "users": USERS}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    frames = {name: table(spark, sf_dir, name) for name in _TABLES if f"{{{name}}}" in sql}
    return spark.sql(sql.replace("{seconds}", _SPARK["seconds"]).replace("{text}", _SPARK["text"]), **frames)


def duck(sql: str) -> str:
    """The view as DuckDB reads it, over the tables' own names."""
    return sql.format(**_DUCK, **{name: name for name in _TABLES})


def lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view(spark, sf_dir, one_pass(LINES[name]))


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view(spark, sf_dir, ROWS[name])
