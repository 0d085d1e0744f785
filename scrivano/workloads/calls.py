"""Call-log queries over ``events``: a call's key is its event type, its time the event's."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivano.operators import calllog as cl
from scrivano.session import scratch_path
from scrivano.streaming.calllog import closing_row, stream_rates, stream_ttl_hits
from scrivano.workloads import Registry, table

REGISTRY = Registry()


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("key"),
        cl.epoch_micros(F.col("ts")).alias("us"),
        "user_id",
        "value",
    )


_SQL_CALLS = """calls as (select event_id, event_type as key, epoch_us(ts) as us, user_id, value
  from events)"""


@REGISTRY.add(
    "request_keys",
    """select event_id, md5('{"args": ["' || event_type || '", ' || user_id
      || '], "kwargs": {"day": ' || day(ts) || ', "props": ' || to_json(props) || '}}') as request_key
    from events""",
)
def request_keys(spark, sf_dir):
    key = cl.request_key(
        F.col("event_type"),
        args=[F.col("user_id")],
        kwargs={"props": F.col("props"), "day": F.dayofmonth("ts")},
    )
    return table(spark, sf_dir, "events").select("event_id", key.alias("request_key"))


def _sql_ttl(ttl, key):
    """The chain of stores, followed call by call: the next store is the first call at its expiry."""
    return f"""with recursive {_SQL_CALLS.replace('event_type as key', key + ' as key')},
      firsts as (select key, us, min(event_id) as event_id from calls group by key, us),
      chain as (select key, min(us) as us from calls group by key
        union all
        select key, us from (select c.key, min(f.us) as us from chain c join firsts f
          on f.key = c.key and f.us >= c.us + {ttl * 1_000_000} group by c.key, c.us) where us is not null)
    select c.event_id, s.event_id is null as is_hit from calls c
      left join (select f.event_id from chain join firsts f using (key, us)) s
      on s.event_id = c.event_id"""


@REGISTRY.add("ttl_hits", _sql_ttl(3600, "event_type"))
def ttl_hits(spark, sf_dir):
    return cl.ttl_hits(_calls(spark, sf_dir)).select("event_id", "is_hit")


@REGISTRY.add("ttl_hits_per_user", _sql_ttl(36000, "user_id"))
def ttl_hits_per_user(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumn("key", F.col("user_id"))
    return cl.ttl_hits(calls, ttl_seconds=36_000).select("event_id", "is_hit")


STREAM_FILES = 5


def _written_stream(spark, frame, closing=None):
    """A stream over ``frame``, ordered by event time into files that arrive one by one.

    ``closing`` is a last file that moves the watermark.
    """
    source = scratch_path(spark, "calls-in")
    days = frame.select(F.min("us").alias("first"), (F.max("us") - F.min("us") + 1).alias("span")).first()
    if days.first is not None:
        piece = F.floor((F.col("us") - days.first) * STREAM_FILES / days.span)
        for i in range(STREAM_FILES):
            frame.filter(piece == i).coalesce(1).write.mode("append").parquet(source)
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    return stream.option("maxFilesPerTrigger", 1).parquet(source)


def _drain(spark, stream, mode="append"):
    out = scratch_path(spark, "calls-out")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "calls-marks"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


@REGISTRY.add("stream_ttl_hits", _sql_ttl(3600, "event_type"))
def stream_ttl_hits_query(spark, sf_dir):
    stream = _written_stream(spark, _calls(spark, sf_dir))
    return _drain(spark, stream_ttl_hits(stream))


@REGISTRY.add(
    "call_rate",
    f"""with {_SQL_CALLS} select event_id, count(*) over w as calls_in_window,
      count(*) over w > 15 as over_limit from calls
    window w as (partition by key order by us range between 3599999999 preceding and current row)""",
)
def call_rate(spark, sf_dir):
    rated = cl.call_rate(_calls(spark, sf_dir), window_seconds=3600)
    return rated.select("event_id", "calls_in_window", "over_limit")


@REGISTRY.add(
    "stream_rates",
    f"""with {_SQL_CALLS}, steps as (select key, us, unnest(generate_series(0, 5)) as back from calls),
      windows as (select key, (us // 600000000 - back) * 600000000 as start from steps)
    select key, start // 1000000 as window_start, count(*) as calls from windows group by key, start""",
)
def stream_rates_query(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    # The last row closes every window: an hour's window and five minutes of watermark, twice over.
    stream = _written_stream(spark, calls, closing_row(calls, seconds=7_800))
    rates = stream_rates(stream, window_seconds=3600, step_seconds=600)
    written = _drain(spark, rates)
    return written.withColumn("window_start", F.unix_seconds("window_start"))


# Error messages made from the events.
_MESSAGE = """case event_id % 7 when 0 then 'HTTP 429: retry in ' || (user_id / 2.0) || ' s'
  when 1 then 'Quota used up, Retry after ' || user_id || 's please'
  when 2 then 'Rate Limit hit; no hint' when 3 then 'connection reset, retry in 5 s'
  when 4 then 'limit EXCEEDED. please retry' || chr(10) || ' in 7 s' when 5 then 'timeout'
  else 'quota: retry_delay { seconds: ' || user_id || ' }' end"""


@REGISTRY.add(
    "quota_errors",
    rf"""with messages as (select event_id, {_MESSAGE.replace('user_id / 2.0', 'user_id / 2.0::double')}
      as message from events),
    tested as (select *, regexp_matches(lower(message), '429|quota|rate limit|exceeded') as q from messages)
    select event_id, q as is_quota_error, case when q then nullif(regexp_extract(message,
      '(?i)retry.*?(\d+(?:\.\d+)?)\s*s', 1), '')::double + 2.0 end as retry_delay from tested""",
)
def quota_errors(spark, sf_dir):
    message = _MESSAGE.replace("user_id / 2.0", "double(user_id) / 2.0d")
    errors = table(spark, sf_dir, "events").select("event_id", F.expr(message).alias("message"))
    return cl.classify_errors(errors).drop("message")


@REGISTRY.add(
    "call_summary",
    """select event_type as name, count(*) as calls, count(*) filter (where value > 100) as failures,
      count(*) filter (where not value > 100) as successes,
      round(avg(value), 6) as mean_duration, max(value) as max_duration
    from events group by event_type""",
)
def call_summary(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"),
        F.col("value").alias("duration"),
        (F.col("value") > 100).alias("failed"),
    )
    return cl.call_summary(calls).withColumn("mean_duration", F.round("mean_duration", 6))
