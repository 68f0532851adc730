"""The directory's relations as views of the driver's tables, the same in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: An invented rule table: line number, start, end, name, code, latitude, longitude, source.
RULES = (
    (1, "A", "C9", "ALPHALAND - North", "AL", 10.0, 20.0, "countrys"),
    (2, "D", "D", "DELTA", "DE", None, None, "countrys"),
    (3, "D2", "D5", "DELTA ISLES", "DI", -12.5, 40.25, "countrys"),
    (4, "E0A", "E9M", "ECHO - East", "EC", 1.0, 2.0, "countrys"),
    (5, "F", "H", "United States", "US", 39.0, -98.0, "countrys"),
    (6, "K1", "K1", "UNITED STATES", None, None, None, "countrys"),
    (7, "I", "L", "CANADA", None, 60.0, -95.0, "countrys"),
    (10, "J2", "J4", "Canada", None, None, None, "countrys"),
    (11, "G5", "G5", "United States", None, None, None, "countrys"),
    (12, "L3", "L3", "LIMA", "CA", None, None, "countrys"),
    (8, "M5", "P", "MIKE", None, None, None, "countrys"),
    (9, "M5", "M7Z", "MIKE ROCKS", "MR", 5.5, 6.5, "countrys"),
    (1, "Q", "S", "QUEBEC - South", "QU", None, None, "pc"),
    (2, "D", "D", "NEVER", "XX", None, None, "pc"),
    (3, "T0", "T4ZZ", "TANGO", "TA", None, None, "pc"),
)
#: Invented centroids.
CENTROIDS = (("DELTA", 7.0, 8.0), ("MIKE", 1.5, 2.5), ("QUEBEC - SOUTH", -30.0, 25.0), ("TANGO", 0.0, 0.5))
#: Publication years that the archive's keys can have, and those that count as marketed.
YEARS = (1992, 1993, 1994, 1995, 1996, 1997, 1998, 1999, 2000, 2001)
MARKETED = (1993, 1995, 1997)


def values(rows: tuple) -> str:
    say = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


def call(key: str, nation: str, duck: bool = False) -> str:
    """A made-up call: a letter, a digit, three letters."""
    div = "//" if duck else "div"
    letter = lambda x: f"chr(cast(65 + {x} as int))"
    parts = [letter(nation), f"cast({key} % 10 as varchar(20))" if duck else f"cast({key} % 10 as string)", *(letter(f"({key} {div} {d}) % 26") for d in (10, 260, 6760))]
    return "concat(" + ", ".join(parts) + ")"


def six(column: str, duck: bool) -> str:
    """A column of six characters."""
    return f"rpad({column}, 6, ' ')"


def views(duck: bool = False) -> dict[str, str]:
    """Each view's SQL; later ones use earlier ones."""
    text = "varchar" if duck else "string"
    code = "lpad(cast(k % 150 as varchar), 4, '0') || lpad(cast((k * 3) % 150 as varchar), 4, '0') || '12'" if duck else "lpad(cast(k % 150 as string), 4, '0') || lpad(cast((k * 3) % 150 as string), 4, '0') || '12'"
    k = "cast(json_extract_string(props, '$.k') as int)" if duck else "cast(get_json_object(props, '$.k') as int)"
    rules = f"select * from (values {values(RULES)}) as t(line_no, start, {'"end"' if duck else 'end'}, name, code, lat, lon, source)"
    if duck:
        rules = rules.replace("select *", 'select line_no, start, "end", name, code, lat::double lat, lon::double lon, source')
    else:
        rules = rules.replace("select *", "select line_no, start, end, name, code, cast(lat as double) lat, cast(lon as double) lon, source")
    return {
        "v_rules": rules,
        "v_centroids": f"select name, cast(lat as double) lat, cast(lon as double) lon from (values {values(CENTROIDS)}) as t(name, lat, lon)",
        "v_calls": f"select c_custkey, c_nationkey, {call('c_custkey', 'c_nationkey', duck)} as call from customer",
        "v_archive": f"""select {call('c_custkey', 'c_nationkey', duck)} as call, cast(year(o_orderdate) as int) as vintage, o_orderkey as seq,
            case when o_orderkey % 3 = 0 then null when o_orderkey % 7 = 0 then '' else concat('F', cast(o_orderkey % 5 as {text})) end as first_name,
            case when o_orderkey % 4 = 1 then concat('M', cast(o_orderkey % 3 as {text})) end as middle_name,
            case when o_orderkey % 5 > 0 then concat('L', cast(o_orderkey % 11 as {text})) end as last_name,
            case when o_orderkey % 2 = 0 then concat('A', cast(o_orderkey % 13 as {text})) end as address,
            case o_orderkey % 3 when 0 then 'us_csv' when 1 then 'dat_idx' else 'hci' end as source,
            case when c_nationkey < 8 then 'united_states' when c_nationkey < 12 then 'canada' when c_nationkey < 20 then 'international' else 'unknown' end as jurisdiction
            from orders join customer on o_custkey = c_custkey""",
        "v_snapshots": "select call, case when seq % 4 = 0 then null else vintage end as vintage, seq, first_name, middle_name, last_name, address, source, jurisdiction from v_archive",
        "v_index": f"""select case when seq % 10 = 0 then concat(call, '/1:2000') when seq % 15 = 0 then concat(call, 'X') when seq % 4 = 0 then call
            else concat(call, ':', cast(vintage as {text})) end as {'"key"' if duck else 'key'}, seq * 7 as dat_offset, seq from v_archive""",
        "v_current": "select c_custkey, concat(' ', lower(call), ' ') as callsign, call as own_call from v_calls where c_custkey % 2 = 0",
        "v_postings": f"""select concat(substr(base, short), case when l_linenumber % 2 = 0 then concat(':', cast(y as {text})) else '' end) as full_key, substr(base, short) as header_key,
            case when l_linenumber % 2 = 0 then y end as year_, l_orderkey as ordinal, cast(l_linenumber as bigint) as posting_no, (l_orderkey * 7 + l_partkey) % 5000 as dat_offset
            from (select *, {call('l_partkey', '(l_partkey % 25)', duck)} as base, case when l_linenumber = 3 then 2 else 1 end as short, cast(year(l_shipdate) as int) as y from lineitem) as l""",
        "v_records": "select o_orderkey * 100 as rec_start, o_orderkey * 100 + 60 as rec_end from orders",
        "v_interests": f"""select event_id as pos, {call('(user_id % 1000)', '(user_id % 25)', duck)} as call, case when event_id % 3 = 0 then null else cast(year(ts) as int) end as vintage, {code} as raw
            from (select *, {k} as k from events) as e""",
        "v_tags": f"""select case l_returnflag when 'A' then 'b6' when 'N' then 'b8' else 'd5' end as tag, concat(l_linestatus, cast(cast(l_quantity as int) as {text})) as value,
            case when l_linenumber % 2 = 0 then null else cast(year(l_shipdate) as int) end as vintage, l_orderkey * 10 + l_linenumber as pos from lineitem""",
        "v_points": """select 'world' as layer, s_nationkey as segment_no, s_suppkey as point_no, s_acctbal / 100 as lon, (s_suppkey % 90) * 1.0 as lat from supplier
            union all select 'county', p_size, p_partkey, p_retailprice / 20, (p_partkey % 60) * 1.0 from part""",
        "v_located": f"""select call, case when seq % 4 = 0 then null else vintage end as vintage, seq as pos, case when seq % 3 = 0 then null when seq % 5 = 0 then '12x' else cast(seq % 90 as {text}) end as latitude,
            case when seq % 11 = 0 then '' else cast(seq % 180 as {text}) end as longitude from v_archive""",
        "v_photos": f"""select concat('P', cast(page_id % 10 as {text})) as call, concat('photos/', cast(page_id as {text}), case page_id % 5 when 0 then '.JPG' when 1 then '.gif' when 2 then '.txt' when 3 then '.tar.gz' else '' end) as path, page_id from pages""",
        # rule lines with marks and blanks in odd places: start and end in any case, names with & and brackets
        "v_rule_lines": f"""select cast(n_nationkey as bigint) as line_no, concat(case when n_nationkey % 9 = 4 then '#' else '' end, {six('start_', duck)}, {six('end_', duck)}, n_name,
            case n_nationkey % 4 when 0 then ' & Isles' when 1 then ' - North' when 2 then '[x]' else '' end, case n_nationkey % 3 when 0 then ' [AB]' when 1 then '' else ' [ c ] ' end,
            case when n_nationkey % 5 > 0 then concat('!', cast(n_nationkey as {text}), '@5#EU$', cast(n_nationkey as {text}), '.5%-7^x&y') else '' end) as line
            from (select *, concat(chr(cast(97 + n_nationkey as int)), '1') as start_, concat(chr(cast(65 + n_nationkey as int)), case when n_nationkey % 7 = 6 then '' else '9Z' end) as end_ from nation) as n""",
        # records that name their country in several spellings, or don't
        "v_records_in": f"""select c_custkey, call as callsign, case c_custkey % 7 when 0 then 'United States' when 1 then 'UNITED STATES' when 2 then 'Canada' when 3 then 'CANADA' when 4 then 'Elsewhere' end as country,
            case when c_custkey % 2 = 0 then 'NJ' end as state_or_province, case when c_custkey % 3 = 0 then '07' end as postal_code from v_calls""",
        "v_manifest": "select (page_id * 7919) % 100003 as line_no, call, lower(substr(path, 8)) as file from v_photos where page_id % 3 = 0",
    }


def register(spark: SparkSession, sf_dir: str) -> None:
    """The tables of sf_dir and the views over them, once a session as long as the folder stays the same."""
    if getattr(spark, "_wavedeck_tables", None) == sf_dir:
        return
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(PREFIX + table)
    for name, text in views().items():
        spark.sql(_own(text)).createOrReplaceTempView(PREFIX + name)
    spark._wavedeck_tables = sf_dir


#: The driver's tables that the views are made of, and what stands before the session's names for them.
TABLES = ("customer", "orders", "lineitem", "events", "supplier", "part", "pages", "nation")
PREFIX = "wavedeck_"


def _own(text: str) -> str:
    """SQL with the session's names of tables and views."""
    return re.sub(r"\b(from|join) (" + "|".join([*TABLES, r"v_\w+"]) + r")\b", rf"\1 {PREFIX}\2", text)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(_own(text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(PREFIX + name)


def oracle(sql: str) -> str:
    """DuckDB SQL over the views: a chain of common table expressions of those that it uses."""
    made, every, wanted = views(duck=True), list(views(duck=True)), set()

    def need(text: str) -> None:
        for name in every:
            if name in text and name not in wanted:
                wanted.add(name)
                need(made[name])

    need(sql)
    chain = ", ".join(f"{name} as ({made[name]})" for name in every if name in wanted)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {chain}, {body[5:]}" if chain else body
    return f"with {chain} {body}" if chain else body
