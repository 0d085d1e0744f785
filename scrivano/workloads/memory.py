"""Conversation memory, prompts and result records over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivano.operators import memory as mem
from scrivano.operators import prompts
from scrivano.plans import jobs
from scrivano.session import scratch_path
from scrivano.sources import readers, writers
from scrivano.streaming.memory import stream_contexts
from scrivano.workloads import Registry, search, table

REGISTRY = Registry()


def _turns(spark, sf_dir):
    return mem.turns_from_messages(table(spark, sf_dir, "conversations"))


# Each message as a turn of its own gives sessions that are long enough for the limits to matter:
# all conversations of one remainder share a session.
_LONG = "'s' || (conv_id % 7)"
_META_SPARK = """case when turn % 3 <> 2 then named_struct('standards_found', int(turn),
  'standards', transform(case when turn > 0 then sequence(1, int(turn)) else array() end,
    i -> conv_id || '//' || i),
  'query_type', case when conv_id % 2 = 0 then 'question' end) end"""


def _long_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.expr(_LONG).alias("session_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("turn_no"),
        F.col("role").alias("query"),
        F.col("text").alias("response"),
        F.expr(_META_SPARK)
        .cast("struct<standards_found:int,standards:array<string>,query_type:string>")
        .alias("metadata"),
    )


_SQL_TURNS = """ordered as (select conv_id::varchar as session_id, turn as turn_no, role,
      text as query, lead(text) over w as response, lead(role) over w as next_role
    from conversations window w as (partition by conv_id order by turn)),
  turns as (select session_id, turn_no, query, response from ordered
    where role = 'user' and next_role = 'assistant')"""
_SQL_META = """case when turn % 3 <> 2 then '{' || chr(10) || '  "standards_found": ' || turn
    || ',' || chr(10) || '  "standards": ' || case when turn = 0 then '[]' else
      '[' || chr(10) || list_aggregate(list_transform(generate_series(1, turn),
        lambda i: '    "' || conv_id || '//' || i || '"'), 'string_agg', ',' || chr(10))
      || chr(10) || '  ]' end
    || case when conv_id % 2 = 0 then ',' || chr(10) || '  "query_type": "question"' else '' end
    || chr(10) || '}' end"""
_SQL_LONG = f"""turns as (select {_LONG} as session_id, conv_id * 100 + turn as turn_no,
    role as query, text as response, {_SQL_META} as meta from conversations)"""
_PART = "'User: ' || query || chr(10) || chr(10) || 'Assistant: ' || response"
_PART_META = f"""{_PART} || case when meta is null then '' else chr(10) || chr(10) || 'Context: '
  || meta end"""


def _sql_back(n):
    return f"""kept as (select * from (select *, row_number() over (partition by session_id
      order by turn_no desc) as back from turns) where back <= {n})"""


@REGISTRY.add(
    "pair_turns", f"with {_SQL_TURNS} select session_id, turn_no, query, response from turns"
)
def pair_turns(spark, sf_dir):
    return _turns(spark, sf_dir)


@REGISTRY.add(
    "last_turns", f"with {_SQL_LONG}, {_sql_back(10)} select session_id, turn_no, back from kept"
)
def last_turns(spark, sf_dir):
    kept = mem.last_turns(_long_turns(spark, sf_dir))
    return kept.select("session_id", "turn_no", F.col("back").cast("long").alias("back"))


@REGISTRY.add(
    "last_two_turns", f"with {_SQL_TURNS}, {_sql_back(2)} select session_id, turn_no, back from kept"
)
def last_two_turns(spark, sf_dir):
    kept = mem.last_turns(_turns(spark, sf_dir), 2)
    return kept.select("session_id", "turn_no", F.col("back").cast("long").alias("back"))


@REGISTRY.add(
    "session_context",
    f"""with {_SQL_TURNS}, {_sql_back(5)} select session_id, string_agg({_PART},
      chr(10) || chr(10) order by turn_no) as context from kept group by session_id""",
)
def session_context(spark, sf_dir):
    return mem.session_context(_turns(spark, sf_dir))


@REGISTRY.add(
    "session_context_with_metadata",
    f"""with {_SQL_LONG}, {_sql_back(5)} select session_id, string_agg({_PART_META},
      chr(10) || chr(10) order by turn_no) as context from kept group by session_id""",
)
def session_context_with_metadata(spark, sf_dir):
    return mem.session_context(_long_turns(spark, sf_dir), include_metadata=True)


def _sql_before(source, part=_PART):
    return f"""with {source} select session_id, turn_no, coalesce(string_agg({part},
      chr(10) || chr(10)) over (partition by session_id order by turn_no
      rows between 5 preceding and 1 preceding), '') as context from turns"""


@REGISTRY.add("context_before_turn", _sql_before(_SQL_TURNS))
def context_before_turn(spark, sf_dir):
    return mem.context_before_turn(_turns(spark, sf_dir))


@REGISTRY.add("context_before_turn_sliced", _sql_before(_SQL_LONG, _PART_META))
def context_before_turn_sliced(spark, sf_dir):
    turns = _long_turns(spark, sf_dir)
    return mem.context_before_turn(turns, include_metadata=True, slice_turns=900)


STREAM_FILES = 5


def _streamed_contexts(spark, turns, **options):
    """Contexts of ``turns`` (with ``ts``) that arrive in time order, a file per micro-batch."""
    source, out, marks = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "marks"))
    ends = turns.select(F.min("turn_no").alias("first"), (F.max("turn_no") - F.min("turn_no") + 1).alias("span")).first()
    if ends.first is None:
        turns.write.parquet(source)
    else:
        piece = F.floor((F.col("turn_no") - ends.first) * STREAM_FILES / ends.span)
        for i in range(STREAM_FILES):
            turns.filter(piece == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream_contexts(stream, **options)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def _timed_turns(spark, sf_dir):
    """Turn numbers as seconds, after the first instant, which no watermark lets pass."""
    return _long_turns(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("turn_no") + 1_000_000))


@REGISTRY.add("stream_contexts", _sql_before(_SQL_LONG))
def stream_contexts_query(spark, sf_dir):
    """The same contexts from a stream of five files: state is carried from one to the next."""
    return _streamed_contexts(spark, _timed_turns(spark, sf_dir), idle="3650 days")


# A turn more than ten minutes after the last one of its session finds an empty memory.
_SQL_IDLE = f"""{_SQL_LONG}, breaks as (select *, coalesce(turn_no - lag(turn_no) over (partition by session_id
    order by turn_no) > 600, true)::int as starts from turns),
  spells as (select *, sum(starts) over (partition by session_id order by turn_no) as spell from breaks)"""


@REGISTRY.add(
    "stream_contexts_idle",
    f"""with {_SQL_IDLE} select session_id, turn_no, coalesce(string_agg({_PART}, chr(10) || chr(10)) over (
      partition by session_id, spell order by turn_no rows between 5 preceding and 1 preceding), '') as context
    from spells""",
)
def stream_contexts_idle(spark, sf_dir):
    """Sessions are forgotten after ten minutes without a turn."""
    return _streamed_contexts(spark, _timed_turns(spark, sf_dir), idle="10 minutes", watermark="1 minute")


@REGISTRY.add(
    "recent_queries",
    f"""with {_SQL_TURNS}, {_sql_back(3)} select session_id, string_agg(query, '|' order by turn_no)
      as recent, count(*) as n from kept group by session_id""",
)
def recent_queries(spark, sf_dir):
    recent = mem.recent_queries(_turns(spark, sf_dir))
    return recent.select(
        "session_id",
        F.array_join("recent_queries", "|").alias("recent"),
        F.size("recent_queries").cast("long").alias("n"),
    )


@REGISTRY.add(
    "session_sizes",
    f"""with {_SQL_LONG} select session_id, count(*) as turns_seen,
      least(count(*), 10) as turns_retained from turns group by session_id""",
)
def session_sizes(spark, sf_dir):
    return mem.session_sizes(_long_turns(spark, sf_dir))


# Sessions with an even number are cleared up to their turn 2, every fifth one completely.
@REGISTRY.add(
    "clear_sessions",
    f"""with {_SQL_TURNS} select session_id, turn_no from turns
      where not (session_id::bigint % 5 = 0 or (session_id::bigint % 2 = 0 and turn_no <= 2))""",
)
def clear_sessions(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    number = F.col("conv_id")
    cleared = (
        table(spark, sf_dir, "conversations")
        .filter((number % 5 == 0) | (number % 2 == 0))
        .select(
            number.cast("string").alias("session_id"),
            F.when(number % 5 != 0, F.lit(2)).cast("long").alias("cleared_at"),
        )
    )
    return mem.clear_sessions(turns, cleared).select("session_id", "turn_no")


@REGISTRY.add(
    "history_listing",
    f"""with {_SQL_LONG}, {_sql_back(10)}, numbered as (select *, row_number() over
      (partition by session_id order by turn_no) as number from kept)
    select session_id, back as position, number, case when query = 'user'
      then 'Question #' || number || ' - ' || substr(response, 1, 60) || '... ('
        || (turn_no % 4) || ' standards)'
      else 'Analysis #' || number || ' - ' || substr(response, 1, 60) || '... ('
        || (turn_no % 4) || ' standards, ' || len(response) || ' chars)' end as label
    from numbered""",
)
def history_listing(spark, sf_dir):
    history = _long_turns(spark, sf_dir).select(
        "session_id",
        "turn_no",
        (F.col("query") == "user").alias("is_question"),
        F.col("response").alias("preview"),
        (F.col("turn_no") % 4).alias("standards_found"),
        F.length("response").alias("text_length"),
    )
    listed = mem.history_listing(history)
    return listed.select(
        "session_id",
        F.col("position").cast("long").alias("position"),
        F.col("number").cast("long").alias("number"),
        "label",
    )


@REGISTRY.add(
    "history_round_trip",
    f"""with {_SQL_LONG}, {_sql_back(10)} select session_id, row_number() over (partition by
      session_id order by turn_no) - 1 as turn_no, 't' || turn_no as timestamp, query, response,
      meta is not null as has_metadata from kept""",
)
def history_round_trip(spark, sf_dir):
    """Histories written as JSON records, one per session, and read back."""
    path = scratch_path(spark, "history")
    turns = _long_turns(spark, sf_dir)
    stamped = turns.withColumn("timestamp", F.concat(F.lit("t"), F.col("turn_no").cast("string")))
    writers.write_history(stamped, path, saved_at="2024-01-01T00:00:00")
    loaded = readers.read_history(spark, path)
    return loaded.select(
        "session_id",
        "turn_no",
        "timestamp",
        "query",
        "response",
        F.col("metadata").isNotNull().alias("has_metadata"),
    )


# Prompts: hits of the benchmark queries among the documents, with the conversation of a session.


def _requests(spark, sf_dir):
    asked = search._queries(spark, sf_dir)
    context = mem.session_context(_turns(spark, sf_dir))
    session = (F.col("query_id") * 3).cast("string")
    return asked.withColumn("session_id", session).join(context, "session_id", "left")


def _label_hits(spark, sf_dir):
    hits = search._label_hits(spark, sf_dir)
    index = F.col("embedding_index")
    return hits.select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        F.concat(F.col("label"), F.lit("//"), index).alias("section_path"),
        F.when(index % 3 != 0, index.cast("string")).alias("section_number"),
        "content",
        (F.lit(1.0) - F.col("distance")).alias("relevance_score"),
        F.length("content").alias("content_length"),
    )


_QUOTED = """'Standard ' || label || '//' || doc_id || ' (' || case when doc_id % 3 <> 0
  then doc_id::varchar else 'N/A' end || '):' || chr(10) || content"""
_SQL_SECTIONS_CONTEXT = f"""{search._SQL_LABEL_HITS}, sc as (select query_id,
    string_agg({_QUOTED}, chr(10) || chr(10) order by place) as sections,
    string_agg({_QUOTED}, chr(10) || chr(10) order by place) filter (where place <= 5) as top_sections
    from near group by query_id)"""


@REGISTRY.add("sections_context", f"with {_SQL_SECTIONS_CONTEXT} select query_id, sections from sc")
def sections_context(spark, sf_dir):
    return prompts.sections_context(_label_hits(spark, sf_dir))


def _sql_template(template, text, sections):
    out = template.replace("'", "''")
    out = out.replace("{text}", f"' || {text} || '").replace("{history}", "' || history || '")
    out = out.replace("{sections}", f"' || coalesce({sections}, '') || '")
    return "'" + out + "'"


_SQL_REQUESTS = f"""{_SQL_TURNS}, {_sql_back(5)}, contexts as (select session_id,
      string_agg({_PART}, chr(10) || chr(10) order by turn_no) as context
      from kept group by session_id),
    {search._SQL_QUERIES}, {_SQL_SECTIONS_CONTEXT},
    requests as (select q.query_id, q.query, case when coalesce(context, '') <> '' then chr(10)
      || chr(10) || 'PREVIOUS CONVERSATION:' || chr(10) || context || chr(10) else '' end as history,
      sections, top_sections from queries q
      left join contexts c on c.session_id = (q.query_id * 3)::varchar
      left join sc on sc.query_id = q.query_id)"""


@REGISTRY.add(
    "question_prompts",
    f"""with {_SQL_REQUESTS} select query_id, query,
      {_sql_template(prompts.QUESTION_TEMPLATE, 'query', 'sections')} as prompt from requests""",
)
def question_prompts(spark, sf_dir):
    return prompts.build_prompts(_requests(spark, sf_dir), _label_hits(spark, sf_dir))


@REGISTRY.add(
    "contract_prompts",
    f"""with {search._SQL_LABEL_HITS}, sc as (select query_id, string_agg({_QUOTED},
        chr(10) || chr(10) order by place) as sections from near
        group by query_id),
      requests as (select doc_id as query_id, text as query, '' as history, sections
        from documents left join sc on sc.query_id = doc_id)
    select query_id, query, {_sql_template(prompts.CONTRACT_TEMPLATE, 'query',
      'sections')} as prompt from requests""",
)
def contract_prompts(spark, sf_dir):
    contracts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("query")
    )
    return prompts.build_prompts(contracts, _label_hits(spark, sf_dir), "contract")


@REGISTRY.add(
    "turn_metadata",
    f"""with {search._SQL_LABEL_HITS} select query_id, count(*) as standards_found,
      string_agg(label || '//' || doc_id, ' ' order by place) as standards, 'question' as query_type
    from near group by query_id""",
)
def turn_metadata(spark, sf_dir):
    rows = mem.turn_metadata(_label_hits(spark, sf_dir), "question")
    return rows.select(
        "query_id",
        F.col("metadata.standards_found").cast("long").alias("standards_found"),
        F.array_join("metadata.standards", " ").alias("standards"),
        F.col("metadata.query_type").alias("query_type"),
    )


def _responses(spark, sf_dir):
    """The documents stand in for the responses of an external model."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"),
        "text",
        F.lit("m1").alias("model"),
        F.lit("p1").alias("provider"),
    )


@REGISTRY.add(
    "answer_records",
    f"""with {search._SQL_LABEL_HITS}, {search._SQL_QUERIES}, hits as (select query_id,
        count(*) as n, string_agg(label || '//' || doc_id || '#' || place || '#' || case when
          doc_id % 3 <> 0 then doc_id::varchar else 'N/A' end, ' ' order by place) as found
        from near group by query_id)
    select q.query_id, q.query as question, d.text as answer, case when d.doc_id is not null then 'm1' end as model,
      coalesce(n, 0) as standards_found, coalesce(found, '') as found
    from queries q left join documents d on d.doc_id = q.query_id
    left join hits h on h.query_id = q.query_id""",
)
def answer_records(spark, sf_dir):
    """Records written as JSON lines and read back."""
    records = prompts.assemble_records(
        search._queries(spark, sf_dir), _label_hits(spark, sf_dir), _responses(spark, sf_dir)
    )
    return _read_answers(_written_json(spark, records))


def _written_json(spark, records):
    """The records after a round through the JSON sink; a request's number travels in its record."""
    path = scratch_path(spark, "records")
    numbered = records.withColumn("number", F.col("query_id"))
    writers.write_json_records(prompts.as_json(numbered), path)
    schema = numbered.drop("query_id").schema
    return spark.read.schema(schema).json(path).withColumnRenamed("number", "query_id")


def _read_answers(back):
    found = F.transform(
        "relevant_standards",
        lambda h: F.concat_ws("#", h["section_path"], h["rank"].cast("string"), h["section_number"]),
    )
    return back.select(
        "query_id",
        "question",
        F.col("answer.answer").alias("answer"),
        F.col("summary.llm_model").alias("model"),
        F.col("summary.standards_found").cast("long").alias("standards_found"),
        F.array_join(found, " ").alias("found"),
    )


@REGISTRY.add(
    "contract_turns",
    """select doc_id as query_id, 'Analyze contract (' || len(text) || ' chars)' as query
    from documents""",
)
def contract_turns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("query_id"), mem.contract_label(F.col("text")).alias("query")
    )


# Contracts: every document is one, answered by the next document; the last one has no answer.
_SQL_FOUND = """hits as (select query_id, count(*) as n, string_agg(label || '//' || doc_id, ' ' order by place) as found
    from near group by query_id)"""


@REGISTRY.add(
    "contract_records",
    f"""with {search._SQL_LABEL_HITS}, {_SQL_FOUND}
    select d.doc_id as query_id, len(d.text) as contract_length, a.text as analysis,
      case when a.doc_id is not null then 'm1' end as model, coalesce(n, 0) as standards_found,
      coalesce(found, '') as found
    from documents d left join documents a on a.doc_id = d.doc_id + 1
    left join hits h on h.query_id = d.doc_id""",
)
def contract_records(spark, sf_dir):
    """The contract form of the records, through the JSON sink."""
    records, _ = _finished_contracts(spark, sf_dir)
    back = _written_json(spark, records)
    paths = F.transform("relevant_standards", lambda h: h["section_path"])
    return back.select(
        "query_id",
        F.col("contract_length").cast("long").alias("contract_length"),
        F.col("analysis.analysis").alias("analysis"),
        F.col("summary.llm_model").alias("model"),
        F.col("summary.standards_found").cast("long").alias("standards_found"),
        F.array_join(paths, " ").alias("found"),
    )


def _finished_contracts(spark, sf_dir):
    contracts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    responses = _responses(spark, sf_dir).withColumn("query_id", F.col("query_id") - 1)
    return jobs.finish_requests(contracts, _label_hits(spark, sf_dir), responses, "contract")


@REGISTRY.add(
    "contract_answers",
    f"""with {search._SQL_LABEL_HITS}, {_SQL_FOUND}
    select d.doc_id as query_id, 'Analyze contract (' || len(d.text) || ' chars)' as query, a.text as response,
      coalesce(n, 0) as standards_found, coalesce(found, '') as standards
    from documents d left join documents a on a.doc_id = d.doc_id + 1
    left join hits h on h.query_id = d.doc_id""",
)
def contract_answers(spark, sf_dir):
    """The turns that analysed contracts leave in the memory."""
    _, turns = _finished_contracts(spark, sf_dir)
    return turns.select(
        "query_id", "query", "response",
        F.col("metadata.standards_found").cast("long").alias("standards_found"),
        F.array_join("metadata.standards", " ").alias("standards"),
    )


# Every message with an odd conversation is without a session, and turn numbers leap.
_SQL_LOOSE = f"""turns as (select case when conv_id % 2 = 0 then 's' || (conv_id % 7) end as session_id,
    conv_id * 1000 + turn * 7 as turn_no, role as query, text as response from conversations)"""


@REGISTRY.add("context_without_session", _sql_before(_SQL_LOOSE))
def context_without_session(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.expr("case when conv_id % 2 = 0 then 's' || (conv_id % 7) end").alias("session_id"),
        (F.col("conv_id") * 1000 + F.col("turn") * 7).alias("turn_no"),
        F.col("role").alias("query"),
        F.col("text").alias("response"),
    )
    return mem.context_before_turn(turns, slice_turns=9_000)


@REGISTRY.add(
    "pair_leaping_turns",
    """with ordered as (select case when conv_id % 3 <> 0 then conv_id::varchar end as session_id,
      conv_id * 1000 + turn * turn * 5 as turn_no, role, text as query, lead(text) over w as response,
      lead(role) over w as next_role from conversations
      window w as (partition by case when conv_id % 3 <> 0 then conv_id end order by conv_id * 1000 + turn * turn * 5))
    select session_id, turn_no, query, response from ordered where role = 'user' and next_role = 'assistant'""",
)
def pair_leaping_turns(spark, sf_dir):
    """Turns of messages whose positions have gaps; a third of the conversations has no session."""
    messages = table(spark, sf_dir, "conversations").select(
        F.expr("case when conv_id % 3 <> 0 then conv_id end").alias("conv_id"),
        (F.col("conv_id") * 1000 + F.col("turn") * F.col("turn") * 5).alias("turn"),
        "role",
        "text",
    )
    return mem.turns_from_messages(messages)
