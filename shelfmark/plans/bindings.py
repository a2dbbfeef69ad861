"""The given tables read in the roles of the domain model.

Each role is one projection, written once as expressions that Spark SQL and ANSI SQL share, so
that a query and its check start from the same rows. No role filters or limits its table.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30 15:30:00"
TZ = "Asia/Shanghai"  # UTC+8 all year

_SOURCE_TYPE = "case l_suppkey % 4 when 0 then '115' when 1 then '123' when 2 then 'guangya' else 'ed2k' end"
_KEY = "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string))"

ROLES: dict[str, tuple[str, dict[str, str]]] = {
    # one row per work
    "work": ("orders", {
        "id": "o_orderkey",
        "title": "concat(substring(o_orderpriority, 3, 20), ' Part ', cast(o_custkey as string))",
        "title_key": "concat(lower(replace(substring(o_orderpriority, 3, 20), ' ', '')), 'part', cast(o_custkey as string))",
        "year": "case when o_orderpriority = '4-NOT SPECIFIED' then null else cast(year(o_orderdate) as int) end",
        "release_date": "case when o_orderstatus = 'P' then '' else substring(cast(o_orderdate as string), 1, 10) end",
        "media_type": "case o_custkey % 3 when 0 then 'movie' when 1 then 'tv' else 'unknown' end",
        "resource_kind": "case o_custkey % 17 when 0 then 'person' when 1 then 'series' else 'media' end",
        "status": "case o_orderstatus when 'F' then 'matched' when 'O' then 'pending' else "
        "(case o_custkey % 5 when 0 then 'error' when 1 then 'not_found' else 'review' end) end",
        "catalogue_id": "case when o_orderstatus = 'F' then o_custkey else null end",
        "catalogue_type": "case when o_orderstatus = 'F' then (case o_custkey % 2 when 0 then 'movie' else 'tv' end) else null end",
        "catalogue_title": "case when o_orderstatus = 'F' then concat('Catalogue ', cast(o_custkey as string)) else null end",
        "poster": "case when o_custkey % 3 = 0 then null else concat('/p', cast(o_orderkey as string), '.jpg') end",
        "is_bundle": "o_custkey % 11 = 0",
        "is_metadata": "o_custkey % 13 = 0",
        "vote": "case when o_orderstatus = 'F' then o_totalprice else null end",
        "confidence": "case when o_orderstatus = 'O' then null else o_totalprice end",
        "genres": "case o_custkey % 6 when 0 then '[{\"id\":16,\"name\":\"Animation\"}]' when 1 then '[{\"id\":99,\"name\":\"Documentary\"},{\"id\":18,\"name\":\"Drama\"}]' "
        "when 2 then '[{\"id\":18,\"name\":\"Drama\"}]' when 3 then 'broken' when 4 then '{}' else '[]' end",
        "countries": "case o_custkey % 4 when 0 then '[\"US\",\"jp\"]' when 1 then '[\"FR\"]' when 2 then 'oops' else '[\"CN\",\"HKG\"]' end",
        "collection_id": "case when o_custkey % 4 = 0 then o_custkey % 50 else null end",
        "created_at": "o_orderdate",
        "updated_at": "o_orderdate",
    }),
    # one row per link or file
    "resource": ("lineitem", {
        "id": _KEY,
        "work_id": "l_orderkey",
        "source_key": _KEY,
        "source_type": _SOURCE_TYPE,
        "provider": "case l_suppkey % 5 when 4 then 'aliyun' when 3 then 'elsewhere' else '115' end",
        "raw_label": "case when l_tax > 0.07 then '' else concat('Label ', l_returnflag, ' ', cast(l_partkey as string)) end",
        "filename": "case l_partkey % 8 when 0 then concat('part', cast(l_partkey as string), '.mkv') when 1 then 'poster.jpg' when 2 then 'tvshow.nfo' "
        "when 3 then 'theme.mp3' when 4 then concat('track', cast(l_linenumber as string), '.flac') when 5 then null when 6 then 'poster.png' else 'IMG_001.jpg' end",
        "file_size": "cast(l_quantity as bigint) * 1000",
        "season": "case when l_suppkey % 7 = 0 then null else cast(1 + l_suppkey % 3 as int) end",
        "season_end": "case when l_suppkey % 7 = 1 then cast(3 as int) else null end",
        "episode": "case when l_tax = 0.0 then null else cast(l_linenumber as int) end",
        "parsed_year": "case when l_returnflag = 'N' then null else cast(year(l_shipdate) as int) end",
        "quality": "case l_returnflag when 'R' then '2160p' when 'A' then ' 1080P ' else (case l_linestatus when 'O' then '4K' else null end) end",
        "codec": "case l_suppkey % 6 when 0 then 'x265' when 1 then 'H.264' when 2 then 'HEVC' when 3 then '' when 4 then 'AV1' else null end",
        "hdr": "case l_partkey % 6 when 0 then 'DV + HDR10' when 1 then 'HDR10+' when 2 then 'SDR' when 3 then null when 4 then ' ' else 'HDR10+ + HDR10' end",
        "resource_class": "case l_partkey % 10 when 0 then 'music' when 1 then 'nsfw' when 2 then 'person' when 3 then 'collection' when 4 then 'other' else 'media' end",
        "tags": "case l_partkey % 4 when 0 then '[\"alpha\",\"beta\"]' when 1 then '[\"beta\", \"gamma\"]' when 2 then '{\"not\":\"a list\"}' else null end",
        "availability": "case l_linenumber % 4 when 0 then 'available' when 1 then 'pending' when 2 then 'invalid' else 'unknown' end",
        "url": "concat('https://115.com/s/c', cast(l_partkey as string), '?password=p', cast(l_suppkey as string))",
        "last_checked_at": "case when l_linenumber % 2 = 0 then l_shipdate else null end",
        "created_at": "l_shipdate",
    }),
    # one row per delivered message
    "message": ("events", {
        "id": "event_id",
        "channel_id": "cast(user_id as string)",
        "channel_username": "case user_id % 3 when 0 then '' when 1 then null else concat('chan_', cast(user_id as string)) end",
        "channel_name": "case when user_id % 10 = 0 then null else concat('Channel ', cast(user_id % 40 as string)) end",
        "message_id": "cast(event_id % 977 as string)",
        "status": "case event_type when 'purchase' then 'imported' when 'view' then 'duplicate' when 'click' then 'ignored' "
        "when 'error' then 'failed' else (case user_id % 2 when 0 then 'queued' else 'pending_validation' end) end",
        "raw_text": "props",
        "received_at": "ts",
    }),
    # one row per link found in a message
    "link": ("lineitem", {
        "message_id": "l_orderkey",
        "source_key": f"case when l_returnflag = 'A' then cast(l_partkey as string) else {_KEY} end",
        "work_id": "case when l_tax > 0.04 then null else l_orderkey end",
        "status": "case l_returnflag when 'R' then 'inserted' when 'A' then 'duplicate' else (case l_linenumber % 3 when 0 then 'invalid' when 1 then 'pending_validation' else 'error' end) end",
        "processed_at": "l_shipdate",
    }),
    # scored proposals for a work
    "candidate": ("lineitem", {
        "id": _KEY,
        "work_id": "l_orderkey",
        "catalogue_id": "l_partkey",
        "score": "floor(l_extendedprice / 10) / 10000",
        "title": "concat('Candidate ', cast(l_partkey as string))",
        "exact": "l_linestatus = 'F'",
        "year_missing": "l_returnflag = 'N'",
    }),
    # delivered posts: a heading line, a metadata line, a link line, a line with its access code
    "post": ("orders", {
        "id": "o_orderkey",
        "text": "concat(case when o_orderstatus = 'O' then '🎥 ' else '📺 ' end, 'Work ', cast(o_custkey as string), ' (', cast(year(o_orderdate) as string), ') ', "
        "case when o_orderstatus = 'O' then '电影 2160p HEVC DV' else concat('S0', cast(1 + o_custkey % 3 as string), 'E', cast(10 + o_custkey % 9 as string), ' 1080p x264') end, chr(10), "
        "'🌟 评分：', cast(o_custkey % 10 as string), chr(10), "
        "case o_custkey % 3 when 0 then '链接：' when 1 then 'Own label ' else '🔗 ' end, "
        "case when o_custkey % 2 = 0 then concat('https://115.com/s/sw', cast(o_custkey as string), '?password=ab', cast(10 + o_custkey % 90 as string), '#') "
        "else concat('https://www.123865.com/s/k', cast(o_orderkey as string)) end, chr(10), '提取码：x', cast(100 + o_custkey % 900 as string))",
    }),
    "collection": ("part", {
        "id": "p_partkey",
        "title": "p_name",
        "title_key": "replace(p_name, ' ', '')",
    }),
}


class Tables:
    """The given tables, plain or in a role."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in ROLES:
            table, columns = ROLES[name]
            return self.read(table).selectExpr(*[f"{e} as `{c}`" for c, e in columns.items()])
        return self.read(name)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")


@lru_cache
def role_sql(name: str) -> str:
    table, columns = ROLES[name]
    body = ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
    return f"{name} AS (SELECT {body} FROM {table})"
