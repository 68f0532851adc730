"""The registered queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import country, layers, lookup, merge, profile, statistics, tally
from . import adapters
from .adapters import MARKETED, YEARS, oracle, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return keep


def rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = view(spark, sf_dir, "v_rules").withColumn("cleaned_name", N.clean_label(F.col("name"))).withColumn("jurisdiction", N.rule_jurisdiction(F.col("code"), F.col("name")))
    return every.where("source = 'countrys'"), every.where("source = 'pc'")


_MATCH = """case when r.start = r."end" then starts_with(c.call, r.start)
    else substr(c.call, 1, least(greatest(length(r.start), length(r."end")), length(c.call))::bigint) between substr(r.start, 1, least(greatest(length(r.start), length(r."end")), length(c.call))::bigint)
    and substr(r."end", 1, least(greatest(length(r.start), length(r."end")), length(c.call))::bigint) end"""
#: As the rule files are read: the code decides, or the name in capitals; everything else is international.
_JUR = "case when coalesce(code, '') = 'US' then 'united_states' when name = 'UNITED STATES' then 'united_states' when coalesce(code, '') = 'CA' then 'canada' when name = 'CANADA' then 'canada' else 'international' end"
_CLASSIFIED = f"""classified as (select call, name, code, lat, lon, source, {_JUR} as jurisdiction from (select c.call, r.name, r.code, r.lat, r.lon, r.source,
    row_number() over (partition by c.call order by r.source, length(r.start) desc, r.start, r.line_no) as rn from v_calls c left join v_rules r on (WHERE_) and {_MATCH}) where rn = 1)"""
_PRIMARY, _ALL = _CLASSIFIED.replace("WHERE_", "r.source = 'countrys'"), _CLASSIFIED.replace("WHERE_", "true")


# --- country -----------------------------------------------------------------------------------------
@query(f"with {_PRIMARY} select call, name, code, case when name is null then null else jurisdiction end as jurisdiction from classified")
def classify_prefix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, _ = rules(spark, sf_dir)
    return country.country_info(view(spark, sf_dir, "v_calls"), primary).select("call", "name", "code", "jurisdiction")


@query(
    f"""with {_ALL} select call, c.name, source, trim(split_part(c.name, ' - ', 1)) as cleaned_name, coalesce(c.lat, z.lat) as lat, coalesce(c.lon, z.lon) as lon
    from classified c left join v_centroids z on upper(trim(c.name)) = z.name"""
)
def classify_primary_fallback_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, fallback = rules(spark, sf_dir)
    found = country.country_info(view(spark, sf_dir, "v_calls"), primary, fallback, view(spark, sf_dir, "v_centroids"))
    return found.select("call", "name", "source", "cleaned_name", "lat", "lon")


@query(
    """select source, count(*) as rules, count(*) filter (where start <> "end") as ranges, count(distinct name) as raw_labels, count(distinct trim(split_part(name, ' - ', 1))) as cleaned_labels,
    count(*) filter (where lat is not null and lon is not null) as located from v_rules group by source"""
)
def country_catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, fallback = rules(spark, sf_dir)
    return country.catalog_statistics(primary.unionByName(fallback))


@query(
    """with r as (select line_no, substr(line, 1, 6) as a, substr(line, 7, 6) as b, trim(substr(line, 13)) as rest from v_rule_lines where substr(line, 1, 1) <> '#' and length(line) >= 12),
    m as (select *, case when strpos(rest, ' [') > 0 then strpos(rest, ' [') else 999 end as open_, list_min([case when strpos(rest, x) > 0 then strpos(rest, x) else 999 end for x in ['!', '@', '#', '$', '%', '^']]) as mark from r),
    n as (select *, trim(substr(rest, 1, least(open_, mark) - 1)) as name, case when open_ < 999 then nullif(trim(split_part(substr(rest, open_ + 2), ']', 1)), '') end as code from m)
    select line_no, upper(trim(a)) as start, upper(trim(b)) as "end", name, code, trim(split_part(name, ' - ', 1)) as cleaned_name, case when strpos(rest, '!') > 0 then split_part(substr(rest, strpos(rest, '!') + 1), '@', 1)::int end as itu,
        case when strpos(rest, '$') > 0 then split_part(substr(rest, strpos(rest, '$') + 1), '%', 1)::double end as lat, case when strpos(rest, '#') > 0 then split_part(substr(rest, strpos(rest, '#') + 1), '$', 1) end as continent,
        case when code = 'US' or name = 'UNITED STATES' then 'united_states' when code = 'CA' or name = 'CANADA' then 'canada' else 'international' end as jurisdiction
    from n where trim(a) <> '' and trim(b) <> '' and name <> ''"""
)
def parse_rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = country.parse_rules(view(spark, sf_dir, "v_rule_lines"), "countrys")
    return made.select("line_no", "start", "end", "name", "code", "cleaned_name", "itu", "lat", "continent", "jurisdiction")


@query(
    f"""with {_PRIMARY.replace('v_calls', '(select callsign as call from v_records_in where country is null)')} select c_custkey, callsign, coalesce(i.country, c.name) as country,
    case when i.country in ('United States', 'UNITED STATES') then 'united_states' when i.country in ('Canada', 'CANADA') then 'canada' when i.country is not null then 'international' when c.name is not null then c.jurisdiction
    when state_or_province is not null and postal_code is not null then 'united_states' else 'unknown' end as jurisdiction from v_records_in i left join classified c on c.call = i.callsign and i.country is null"""
)
def apply_country_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = country.apply_country(view(spark, sf_dir, "v_records_in"), rules(spark, sf_dir)[0])
    return made.select("c_custkey", "callsign", "country", "jurisdiction")


# --- tallies ---------------------------------------------------------------------------------------
_RUNS = f"""{_ALL}, ordered as (select call, coalesce(name, 'none') as country from classified), marked as (select *, case when country = lag(country) over (order by call) then 0 else 1 end as new from ordered),
    numbered as (select *, sum(new) over (order by call rows unbounded preceding) as run_no from marked),
    runs as (select cast(run_no as bigint) as run_no, country, count(*) as calls, min(call) as first_call, max(call) as last_call from numbered group by all)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, fallback = rules(spark, sf_dir)
    found = country.country_info(view(spark, sf_dir, "v_calls"), primary, fallback)
    return tally.islands(found.select("call", F.coalesce("name", F.lit("none")).alias("country"), F.substring("call", 1, 2).alias("part")))


@query(f"with {_RUNS} select * from runs")
def tally_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query(f"with {_RUNS} select country, count(*) as runs, cast(sum(calls) as bigint) as calls, arg_max(last_call, run_no) as last_call from runs group by country")
def tally_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.totals(_runs(spark, sf_dir))


@query(
    f"""with {_RUNS}, a as (select country, sum(calls) as n from runs group by country), b as (select coalesce(name, 'none') as country, count(*) as n from classified join v_archive using (call) group by 1),
    d as (select coalesce(a.country, b.country) as country, cast(coalesce(a.n, 0) as bigint) as left_calls, cast(coalesce(b.n, 0) as bigint) as right_calls from a full join b on a.country = b.country)
    select *, left_calls - right_calls as delta from d order by abs(left_calls - right_calls) desc, country limit 5"""
)
def tally_gaps_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary, fallback = rules(spark, sf_dir)
    of = country.country_info(view(spark, sf_dir, "v_calls"), primary, fallback).select("call", F.coalesce("name", F.lit("none")).alias("country"))
    archive = view(spark, sf_dir, "v_archive").join(of, "call").groupBy("country").agg(F.count("*").alias("calls"))
    return tally.largest_gaps(tally.differences(tally.totals(_runs(spark, sf_dir)), archive), 5)


# --- merge and lookup ------------------------------------------------------------------------------
FIELDS = ("first_name", "middle_name", "last_name", "address", "jurisdiction")


def _merged(table: str, keys: str, more: str = "") -> str:
    first = lambda c: f"arg_min({c}, seq) filter (where {c} <> '') as {c}"
    return f"""(select {keys}, {first('first_name')}, {first('middle_name')}, coalesce(arg_max(last_name, seq) filter (where rn > 1 and seen = 1 and (coalesce(first_name, '') <> '' or coalesce(middle_name, '') <> '') and last_name <> ''),
        arg_min(last_name, seq) filter (where last_name <> '')) as last_name, {first('address')}, coalesce(arg_min(jurisdiction, seq) filter (where jurisdiction <> 'unknown'), 'unknown') as jurisdiction,
        array_to_string(list_sort(list(distinct source)), '|') as sources {more}
        from (select *, row_number() over (partition by {keys} order by seq) as rn, max(case when first_name <> '' then 1 else 0 end) over (partition by {keys} order by seq rows unbounded preceding) as seen from {table}) group by {keys})"""


@query(f"select * from {_merged('v_archive', 'call')}")
def merge_current_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(view(spark, sf_dir, "v_archive"), ["call"], "seq", FIELDS, sources="source").withColumnRenamed("source", "sources").withColumn("sources", F.array_join("sources", "|"))


@query(f"select * from {_merged('v_archive', 'call, vintage')}")
def merge_history_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(view(spark, sf_dir, "v_archive"), ["call", "vintage"], "seq", FIELDS, sources="source").withColumnRenamed("source", "sources").withColumn("sources", F.array_join("sources", "|"))


@query(
    f"""with m as {_merged('v_snapshots', 'call, vintage')}, h as (select call, count(*) as n, string_agg(vintage::varchar || '=' || coalesce(last_name, ''), '|' order by vintage) as years from m where vintage is not null group by call),
    asked as (select call from v_calls union select 'NOPE' || (c_custkey % 7)::varchar from v_calls)
    select a.call, case when c.call is not null then 'current' when h.n > 0 then 'archive_only' else 'not_found' end as status, c.first_name, c.last_name, c.sources, coalesce(h.n, 0) as history_rows, coalesce(h.years, '') as years,
        trim(concat_ws(' ', c.first_name, c.middle_name, c.last_name)) as shown
    from asked a left join (select * from m where vintage is null) c on a.call = c.call left join h on a.call = h.call"""
)
def lookup_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = view(spark, sf_dir, "v_calls")
    asked = calls.select("call").unionByName(calls.select(F.concat(F.lit("NOPE"), (F.col("c_custkey") % 7).cast("string")).alias("call")))
    found = lookup.batch(asked, view(spark, sf_dir, "v_snapshots").withColumnRenamed("call", "callsign"), FIELDS)
    years = F.array_join(F.transform("history", lambda h: F.concat(h["vintage"].cast("string"), F.lit("="), F.coalesce(h["last_name"], F.lit("")))), "|")
    shown = N.display_name(*(F.col(f"current.{c}") for c in ("first_name", "middle_name", "last_name")), F.lit(None).cast("string"))
    return found.select("call", "status", "current.first_name", "current.last_name", F.array_join("current.sources", "|").alias("sources"), F.size("history").cast("long").alias("history_rows"), years.alias("years"), F.coalesce(shown, F.lit("")).alias("shown"))


_ENTRIES = """entries as (select distinct call from (select case when strlen(split_part("key", ':', 1)) between 1 and 26 then split_part("key", ':', 1) end as call from v_index
    where not contains("key", ':') or regexp_full_match(split_part("key", ':', 2), '(19|20)[0-9][0-9]') union all select upper(trim(callsign)) from v_current) where call is not null)"""


@query(f"with {_ENTRIES} select e.call from entries e where exists (select 1 from v_snapshots s where s.call = e.call and s.vintage is null) or exists (select 1 from v_current c where c.own_call = e.call)")
def entries_current_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = lookup.enumerate_calls(view(spark, sf_dir, "v_index"), view(spark, sf_dir, "v_current")).where("valid")
    now = view(spark, sf_dir, "v_snapshots").where("vintage is null").select("call").unionByName(view(spark, sf_dir, "v_current").select(F.col("own_call").alias("call")))
    return calls.select("call").join(now, "call", "left_semi")


@query(f"with {_ENTRIES} select e.call, count(distinct s.vintage) as vintages, count(*) filter (where s.call is not null and s.vintage is null) > 0 as has_current from entries e left join v_snapshots s on s.call = e.call group by e.call")
def entries_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = lookup.enumerate_calls(view(spark, sf_dir, "v_index"), view(spark, sf_dir, "v_current")).where("valid").select("call")
    of = view(spark, sf_dir, "v_snapshots").groupBy("call").agg(F.countDistinct("vintage").alias("vintages"), F.bool_or(F.col("vintage").isNull()).alias("has_current"))
    return calls.join(of, "call", "left").select("call", F.coalesce("vintages", F.lit(0)).cast("long").alias("vintages"), F.coalesce("has_current", F.lit(False)).alias("has_current"))


_PROBE = f"""k as (select call, unnest(range(2 + 2 * {len(YEARS)})) as key_no from (select distinct {adapters.call('c_custkey', '(c_custkey % 25)', True)} as call from customer)),
    keys as (select call, key_no, substr(call, case when key_no % 2 = 0 then 1 else 2 end) || case when key_no < 2 then '' else ':' || ({YEARS[0]} + (key_no - 2) // 2)::varchar end as key_ from k),
    first as (select call, dat_offset, min(struct_pack(key_no := key_no, ordinal := ordinal, posting_no := posting_no)) as o, arg_min(key_, struct_pack(key_no := key_no, ordinal := ordinal, posting_no := posting_no)) as key_
        from keys join v_postings on key_ = full_key group by call, dat_offset)"""


@query(f'with {_PROBE} select call, dat_offset, key_ as "key", row_number() over (partition by call order by o) as seq from first')
def inv_key_expand_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = view(spark, sf_dir, "v_postings").select(F.col("full_key").alias("header_key"), "ordinal", "posting_no", "dat_offset")
    calls = adapters.sql(spark, sf_dir, f"select distinct {adapters.call('c_custkey', '(c_custkey % 25)')} as call from customer")
    return lookup.probe(lookup.expand_keys(calls, list(YEARS)), postings)


@query(
    """select l_orderkey, l_linenumber, r.rec_start, case when r.rec_start is null then 'none' when r.rec_start = p.dat_offset then 'posting_start' else 'containing' end as how
    from (select l_orderkey, l_linenumber, l_orderkey * 100 + (l_linenumber - 1) * 12 as dat_offset from lineitem) p left join v_records r on p.dat_offset >= r.rec_start and p.dat_offset < r.rec_end"""
)
def inv_containing_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "v_records")
    postings = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 100 + (F.col("l_linenumber") - 1) * 12).alias("dat_offset"))
    return lookup.resolve_records(postings, records).select("l_orderkey", "l_linenumber", "rec_start", "how")


@query(
    """with r as (select call, seq * 40 as rec_start, seq * 40 + 30 + (seq % 50) * 100 as rec_end from v_archive), p as (select call, c_custkey * 400 as dat_offset from v_calls),
    m as (select p.call, dat_offset, rec_start, case when rec_end <= dat_offset + 1024 then 0 when rec_end <= dat_offset + 2048 then 1 when rec_end <= dat_offset + 4096 then 2 else 3 end as tier
        from p join r on r.call = p.call and rec_start >= dat_offset and rec_start < dat_offset + 8192)
    select * from m qualify tier = min(tier) over (partition by call, dat_offset)"""
)
def inv_window_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "v_archive").select(F.col("call").alias("callsign"), (F.col("seq") * 40).alias("rec_start"), (F.col("seq") * 40 + 30 + (F.col("seq") % 50) * 100).alias("rec_end"))
    postings = view(spark, sf_dir, "v_calls").select("call", (F.col("c_custkey") * 400).alias("dat_offset"))
    return lookup.window_fallback(postings, records).select("call", "dat_offset", "rec_start", "tier")


@query(
    """select call, "key", vintage, dat_offset, row_number() over (partition by call order by vintage nulls first, "key", dat_offset) as seq from (select split_part("key", ':', 1) as call, "key", dat_offset,
    try_cast(nullif(split_part("key", ':', 2), '') as int) as vintage from v_index) where call in (select call from v_calls)"""
)
def idx_callsign_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.call_run(view(spark, sf_dir, "v_calls"), view(spark, sf_dir, "v_index"))
    return found.select("call", "key", "vintage", "dat_offset", F.col("seq").cast("long").alias("seq"))


@query('select "key", dat_offset, lead(dat_offset) over (order by "key") as next_offset from (select "key", min(dat_offset) as dat_offset from v_index group by "key")')
def idx_next_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.next_offsets(view(spark, sf_dir, "v_index"))


@query("select call from v_calls where call in (select upper(trim(callsign)) from v_current)")
def us_exact_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exact(view(spark, sf_dir, "v_calls"), view(spark, sf_dir, "v_current").select("callsign"), "left_semi").select("call")


@query("select call from v_calls where call not in (select upper(trim(callsign)) from v_current)")
def us_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exact(view(spark, sf_dir, "v_calls"), view(spark, sf_dir, "v_current").select("callsign"), "left_anti").select("call")


# --- statistics ------------------------------------------------------------------------------------
_J = ", ".join("count(*) filter (where jurisdiction = '{j}') as PRE_{j}".format(j=j) for j in statistics.JURISDICTIONS)


@query(
    f"""with firsts as (select call, arg_min(jurisdiction, src) as jurisdiction from (select call, jurisdiction, 0 as src from v_snapshots where vintage is null union all select own_call, 'united_states', 1 from v_current) group by call),
    a as (select count(*) as current_total, {_J.replace('PRE', 'current')} from firsts), b as (select count(*) as archive_total, {_J.replace('PRE', 'archive')} from v_snapshots where vintage is not null)
    select *, current_total + archive_total as total from a, b"""
)
def stat_records_by_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.record_statistics(view(spark, sf_dir, "v_snapshots"), view(spark, sf_dir, "v_current").select(F.col("own_call").alias("call")))


@query(f"select vintage, count(*) as rows_, {_J.replace('PRE', 'archive')} from v_snapshots where vintage is not null group by vintage")
def stat_archive_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.archive_years(view(spark, sf_dir, "v_snapshots"))


_CALL_HEADER = "regexp_full_match(header_key, '[A-Z0-9/]{1,12}') and regexp_matches(header_key, '[A-Z]') and regexp_matches(header_key, '[0-9]')"


def _posting_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.posting_statistics(view(spark, sf_dir, "v_postings").select("header_key", F.col("year_").alias("year"), "dat_offset"))


@query(
    f"""with p as (select year_, year_ is not null as archive, dat_offset from v_postings where {_CALL_HEADER}) select year_ as "year", archive, count(*) as postings, count(distinct dat_offset) as offsets from p where archive group by all
    union all select null, archive, count(*), count(distinct dat_offset) from p group by archive"""
)
def stat_postings_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posting_statistics(spark, sf_dir)


@query(f"select cast(coalesce(sum(n), 0) as bigint) as offsets from (select year_, count(distinct dat_offset) as n from v_postings where {_CALL_HEADER} and year_ in {MARKETED} group by year_)")
def stat_marketed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.marketed_years(_posting_statistics(spark, sf_dir), MARKETED)


_CODES = "codes as (select pos, call, vintage, unnest([substr(raw, 1, 4), substr(raw, 5, 4)]) as code from v_interests), catalog as (select lpad(i::varchar, 4, '0') as code, 'C' || (i % 4)::varchar as category, 'L' || i::varchar as label from range(120) t(i) where i % 3 > 0)"


def _interests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = view(spark, sf_dir, "v_interests").withColumn("codes", N.interest_codes(F.col("raw")))
    catalog = spark.sql("select lpad(cast(id as string), 4, '0') as code, concat('C', cast(id % 4 as string)) as category, concat('L', cast(id as string)) as label from range(120) where id % 3 > 0")
    return records, catalog


@query(
    f"""with {_CODES}, per as (select call, vintage, pos, bool_or(code in (select code from catalog)) as known from codes group by all) select count(distinct call) filter (where vintage is null) as current_calls,
    count(distinct call) filter (where vintage is null and known) as current_known, count(*) as snapshots, count(*) filter (where known) as snapshots_known, count(*) filter (where vintage is not null) as archive_snapshots from per"""
)
def stat_interest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.interest_statistics(*_interests(spark, sf_dir))


def _first3(group: str, value: str, source: str) -> str:
    return f"""(select {group}, string_agg({value}, '|' order by rn) as samples from (select {group}, {value}, row_number() over (partition by {group} order by min(pos), {value}) as rn from {source} group by {group}, {value}) where rn <= 3 group by {group})"""


@query(
    f"""with {_CODES}, u as (select * from codes where code not in (select code from catalog)), s as {_first3('code', 'call', 'u')} select code, count(*) as total, count(*) filter (where vintage is null) as "current",
    count(*) filter (where vintage is not null) as archive, any_value(samples) as samples from u join s using (code) group by code"""
)
def stat_unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.unknown_codes(*_interests(spark, sf_dir))


@query(f"""with {_CODES} select distinct call, vintage, vintage is null as "current" from codes where code = '0010'""")
def search_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.search_code(_interests(spark, sf_dir)[0], "0010")


@query(
    f"""with s as {_first3('tag', 'value', 'v_tags')} select tag, count(*) as occurrences, count(*) filter (where vintage is null) as "current", count(*) filter (where vintage is not null) as archive, any_value(samples) as samples,
    case tag when 'b6' then 'license_class' when 'b8' then 'first_name' else 'interest_codes' end as field from v_tags join s using (tag) group by tag"""
)
def stat_tags_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.tag_statistics(view(spark, sf_dir, "v_tags"))


@query(
    """select case when dat_offset * 20 >= 60000 then 'out_of_bounds' when dat_offset * 20 in (select rec_start from v_records) then 'record_start' else 'elsewhere' end as kind, count(*) as postings from v_postings group by 1"""
)
def invariant_posting_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = view(spark, sf_dir, "v_postings").withColumn("dat_offset", F.col("dat_offset") * 20)
    return statistics.posting_starts(postings, view(spark, sf_dir, "v_records"), 60_000)[0]


@query(
    """select dat_offset * 20 as dat_offset, ordinal, posting_no from v_postings where dat_offset * 20 >= 60000 or dat_offset * 20 not in (select rec_start from v_records) order by ordinal, posting_no, dat_offset limit 20"""
)
def invariant_posting_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = view(spark, sf_dir, "v_postings").withColumn("dat_offset", F.col("dat_offset") * 20)
    return statistics.posting_starts(postings, view(spark, sf_dir, "v_records"), 60_000)[1].select("dat_offset", "ordinal", "posting_no")


@query(
    """with r as (select *, lag(k) over (order by o_orderkey) as pk, lag(o) over (order by o_orderkey) as po from (select o_orderkey, o_orderkey // 10 * 10 + o_custkey % 20 as k, o_orderkey * 3 + o_custkey % 5 as o from orders))
    select count(*) as rows_, count(*) filter (where k <= pk) as key_order_violations, count(*) filter (where o < po) as offset_violations, min(k) as lowest, max(k) as highest from r"""
)
def verify_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.sql(spark, sf_dir, "select o_orderkey, o_orderkey div 10 * 10 + o_custkey % 20 as k, o_orderkey * 3 + o_custkey % 5 as o, o_orderkey div 1000 as part from orders")
    return statistics.monotonic(rows, "o_orderkey", "k", "o", "part")


# --- layers and profiles ---------------------------------------------------------------------------
@query("select layer, count(distinct segment_no) as segments, count(*) as points from v_points group by layer")
def map_layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer_statistics(view(spark, sf_dir, "v_points"))


@query("select layer, segment_no, least(min(lon), -1.0::double) as min_lon, greatest(max(lon), 1.0::double) as max_lon, min(lat)::double as min_lat, max(lat)::double as max_lat, count(*) as points from v_points group by layer, segment_no")
def bounds_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "v_points").withColumn("lat", F.col("lat").cast("double")).withColumn("min_lon", F.lit(-1.0)).withColumn("max_lon", F.lit(1.0))
    return layers.envelope(points, ("layer", "segment_no"))


@query(
    f"""with {_ALL.replace('classified as', 'countries as')}, {_CODES}, counted as (select call, count(*) as n, count(distinct vintage) filter (where vintage is not null) as years from v_snapshots group by call),
    known as (select call, string_agg(label, '|' order by pos, label) as labels from (select distinct call, pos, c.code, label from codes c join catalog using (code)) group by call),
    slots as (select call as k, c_custkey * 3 as cnt from v_calls where c_custkey % 4 = 0)
    select v.call, case when x.n is null then 'not_found' else 'known' end as status, c.name as country, s.cnt as lookups, coalesce(x.n, 0) as history_rows, coalesce(x.years, 0) as vintages
    from v_calls v left join countries c on v.call = c.call left join counted x on v.call = x.call left join slots s on s.k = v.call"""
)
def profile_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = view(spark, sf_dir, "v_calls")
    snapshots = view(spark, sf_dir, "v_snapshots")
    primary, fallback = rules(spark, sf_dir)
    info = country.country_info(calls, primary, fallback).select("call", F.col("name").alias("country"))
    slots = calls.where("c_custkey % 4 = 0").select(F.col("call").alias("key"), (F.col("c_custkey") * 3).alias("count"), F.lit(20260101).alias("updated"), F.lit("N").alias("status_byte"), F.col("c_custkey").alias("slot_no")).withColumnRenamed("status_byte", "status")
    known = snapshots.select("call").distinct().withColumn("status", F.lit("known"))
    records, catalog = _interests(spark, sf_dir)
    found = profile.star(calls, known.withColumnRenamed("status", "call_status"), info, slots, snapshots, profile.resolve_codes(records, catalog))
    return found.select("call", F.coalesce("call_status", F.lit("not_found")).alias("status"), "country", F.col("count").alias("lookups"), "history_rows", F.coalesce(F.size("vintages"), F.lit(0)).cast("long").alias("vintages"))


@query(
    """select call, vintage, lat::double as lat, lon::double as lon from (select call, vintage, latitude as lat, longitude as lon, row_number() over (partition by call order by vintage is null desc, vintage desc, pos desc) as rn
    from v_located where try_cast(latitude as double) is not null and try_cast(longitude as double) is not null) where rn = 1"""
)
def best_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.best_location(view(spark, sf_dir, "v_located"))


@query(
    """select call, path, line_no as listed, row_number() over (partition by call order by line_no nulls last, path) as photo_rank from v_photos left join (select call, file, min(line_no) as line_no from v_manifest group by all) m
    using (call) where true and (m.file is null or m.file = lower(substr(path, 8))) or false""".replace("using (call) where true and (m.file is null or m.file = lower(substr(path, 8))) or false", "on v_photos.call = m.call and m.file = lower(substr(path, 8))").replace("select call, path", "select v_photos.call, path").replace("partition by call", "partition by v_photos.call")
)
def photo_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ranked_photos(view(spark, sf_dir, "v_photos"), view(spark, sf_dir, "v_manifest"))


@query(
    """select path, case lower(regexp_extract(path, '\\.([^./]+)$', 1)) when 'jpg' then 'image/jpeg' when 'gif' then 'image/gif' when 'txt' then 'text/plain' else 'application/octet-stream' end as media_type from v_photos"""
)
def asset_media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_photos").select("path", N.media_type(F.col("path")).alias("media_type"))


@query(
    """with p as (select l_orderkey, l_linenumber, case when l_linenumber in (2, 5) then 4000 else 1 end as command, l_quantity * 60 as lat_min, l_partkey * 6.0 as lon_min from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)),
    n as (select *, sum(case when command > 10 then 1 else 0 end) over (partition by l_orderkey order by l_linenumber rows unbounded preceding) as segment_no from p)
    select l_orderkey, cast(segment_no as bigint) as segment_no, count(*) as points, sum(cast(lat_min as bigint))::bigint as lat_minutes from n where segment_no > 0 group by l_orderkey, segment_no"""
)
def paths_from_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    points = lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber").isin(2, 5), 4000).otherwise(1).alias("command"), (F.col("x.l_quantity") * 60).alias("lat_min"), (F.col("x.l_partkey") * 6.0).alias("lon_min"))
    made = layers.paths(points, "l_linenumber", "l_orderkey")
    minutes = F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + F.round(p["lat"] * 60).cast("long"))
    return made.select("l_orderkey", "segment_no", F.size("points").cast("long").alias("points"), minutes.alias("lat_minutes"))


@query("select o_orderkey, last_value(case when o_orderkey % 4 = 0 then o_orderpriority end ignore nulls) over (partition by o_custkey order by o_orderkey) as carried from orders")
def category_carry_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.carry_down(view(spark, sf_dir, "orders"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")), "o_orderkey", "o_custkey").select("o_orderkey", "carried")


@query(
    """with ranked as (select *, dense_rank() over (partition by layer order by segment_no) as rank_ from v_points), lines as (select layer, segment_no, string_agg(printf('%.6f,%.6f ', lon::double, -lat::double), '' order by point_no) as p, count(*) as n
        from ranked where rank_ <= 512 and layer in ('world', 'county') group by layer, segment_no),
    ground as (select coalesce(string_agg('<polyline fill="none" stroke="' || case layer when 'world' then '#789" stroke-width="0.25' else '#9ab" stroke-width="0.18' end || '" points="' || p || '"/>', '' order by case layer when 'world' then 0 else 1 end, segment_no), '') as g from lines where n >= 2),
    places as (select call, latitude::double as lat, longitude::double as lon, row_number() over (partition by call order by vintage is null desc, vintage desc, pos desc) as rn from v_located where try_cast(latitude as double) is not null and try_cast(longitude as double) is not null)
    select call, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="-180 -90 360 180">' || g || printf('<circle cx="%.6f" cy="%.6f" r="1.5" fill="#d22"/>', lon, -lat) || '</svg>' as svg from places, ground where rn = 1"""
)
def svg_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = layers.best_location(view(spark, sf_dir, "v_located"))
    drawn = layers.layer_svg(view(spark, sf_dir, "v_points").withColumnRenamed("segment_no", "segment_no"), 512)
    return layers.station_svg(places, drawn, ("world", "county"))


@query(f"with {_PROBE} select call, dat_offset, key_, rec_start, case when rec_start is null then 'none' when rec_start = dat_offset then 'posting_start' else 'containing' end as how from first left join v_records on dat_offset >= rec_start and dat_offset < rec_end")
def trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inv_key_expand_probe(spark, sf_dir)
    return lookup.resolve_records(found, view(spark, sf_dir, "v_records")).select("call", "dat_offset", F.col("key").alias("key_"), "rec_start", "how")


# --- scalar rules ----------------------------------------------------------------------------------
_T = r"[\t\n\f\r ]"


@query(
    f"""with w as (select c_custkey, case c_custkey % 6 when 0 then ' ' || lower(call) || chr(9) when 1 then call || ':' || (1890 + c_custkey % 250)::varchar when 2 then call || '-X' when 3 then '!!!' else call || '/P' end as raw from v_calls)
    select c_custkey, case when regexp_full_match(upper(regexp_replace(raw, '^{_T}+|{_T}+$', '', 'g')), '[A-Z0-9/]{{1,26}}') then upper(regexp_replace(raw, '^{_T}+|{_T}+$', '', 'g')) end as valid_call,
    regexp_full_match(split_part(raw, ':', 1), '[A-Z0-9/]{{1,12}}') as record_key, case when contains(raw, ':') then try_cast(split_part(raw, ':', 2) as int) end as vintage,
    regexp_full_match(raw, '[A-Z0-9/]{{1,12}}') and regexp_matches(raw, '[A-Z]') and regexp_matches(raw, '[0-9]') as header,
    case when (not contains(raw, ':') or split_part(raw, ':', 2) between '1900' and '2099') and not starts_with(raw, '!!!') and regexp_full_match(upper(regexp_replace(split_part(raw, ':', 1), '^{_T}+|{_T}+$', '', 'g')), '[A-Z0-9/]{{1,26}}')
        then upper(regexp_replace(split_part(raw, ':', 1), '^{_T}+|{_T}+$', '', 'g')) end as statistics_call from w"""
)
def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = adapters.sql(spark, sf_dir, "select c_custkey, case c_custkey % 6 when 0 then concat(' ', lower(call), chr(9)) when 1 then concat(call, ':', cast(1890 + c_custkey % 250 as string)) when 2 then concat(call, '-X') when 3 then '!!!' else concat(call, '/P') end as raw from v_calls")
    c = F.col("raw")
    return raw.select("c_custkey", N.callsign(c).alias("valid_call"), N.is_record_key(N.key_call(c)).alias("record_key"), N.key_vintage(c).alias("vintage"), N.is_call_header(c).alias("header"), N.statistics_call(c).alias("statistics_call"))


@query(
    """select seq, bit_or(case s when 'us_csv' then 1 when 'dat_idx' then 2 else 4 end)::int as flags from (select call, min(seq) over (partition by call) as seq, source as s from v_archive) group by seq"""
)
def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = view(spark, sf_dir, "v_archive").groupBy("call").agg(F.min("seq").alias("seq"), F.collect_set("source").alias("sources"))
    return per.select("seq", N.source_flags(F.col("sources")).alias("flags"))
