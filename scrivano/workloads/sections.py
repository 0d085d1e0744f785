"""Sectioning queries over ``documents`` with headers and contents lines put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivano.functions.text import lines_of, strip
from scrivano.operators import embedding as emb
from scrivano.operators import front_matter
from scrivano.operators import sections as sec
from scrivano.session import cut_lineage
from scrivano.workloads import Registry, table

REGISTRY = Registry()

# One rule for both engines: d = document id, p = line position from 0, x = the line.
_LINE = """case
  when (p + d) % 5 = 0 then (d % 9 + 1) || '//' || (p + 1) || ' '
    || case when d % 2 = 0 then 'Title' else x end
  when (p + d) % 5 = 1 and d % 4 = 0 then 'see ... 5 there'
  when (p + d) % 7 = 3 then x || ' ...... ' || p
  when (p + d) % 11 = 4 then (d % 9 + 1) || '//' || (p + 1) || '//2 ' || x || ' .... 7 etc'
  when (p + d) % 13 = 6 then 'Contents'
  when (p + d) % 17 = 9 then 'Shari’ah Standard No. (' || p || ')'
  when (p + d) % 19 = 12 then 'Appendices'
  when (p + d) % 23 = 5 then ''
  when (p + d) % 29 = 7 then '1. Scope ' || x || ' ... ' || p
  when (p + d) % 31 = 8 then '2//1,2//1,' || x || ' ..... 88,89'
  when (p + d) % 37 = 9 then 'Preface'
  when (p + d) % 41 = 3 then '  2019 ' || x
  when (p + d) % 43 = 11 then 'Statement of the Standard'
  else x end"""
_HEAD = """case when d % 10 = 9 then 'No standard here' else
  'Front page' || chr(10) || 'Shari''ah Standard No. (' || d || '): trade' || chr(10) || 'Contents'
  || chr(10) || 'Subject Page' || chr(10) || 'Scope ...... 3' || chr(10)
  || case when d % 3 = 0 then chr(10) || chr(10) || chr(10) else '' end
  || case when d % 4 = 1 then 'Preface ..... 5' || chr(10) || 'We thank' || chr(10) else '' end
  || 'Body' end"""


def _documents(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    placed = (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("d"), lines.alias("l"))
        .selectExpr("d", "transform(l, (x, p) -> " + _LINE + ") as l")
    )
    # Spark reads '' inside a string as nothing, so the apostrophe is written as a character code.
    head = _HEAD.replace("Shari''ah", "Shari' || chr(39) || 'ah")
    return placed.select(
        F.col("d").alias("doc_id"),
        F.concat(F.expr(head), F.lit("\n"), F.array_join("l", "\n")).alias("text"),
    )


# The SQL side works line by line with windows, unlike the Spark side.
_SRC = f"""src as (select d as doc_id, {_HEAD} || chr(10) || string_agg(line, chr(10) order by p)
    as text from (select d, p, {_LINE} as line from (
      select doc_id as d, unnest(string_split(text, chr(10))) as x,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 as p from documents)) group by d)"""
_STD = r"Shari[''’]ah Standard No\.\s*\(\d+\)"
_CUT = rf"""cut as (select doc_id, regexp_extract(text, '(?is){_STD}.*') as text from src
    where regexp_matches(text, '(?i){_STD}'))"""


def _sql_lines(source, name):
    return f"""{name} as (select doc_id, pos, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as s
      from (select doc_id, unnest(string_split(text, chr(10))) as line,
        generate_subscripts(string_split(text, chr(10)), 1) as pos,
        len(string_split(text, chr(10))) as n from {source})
      where pos < n or line <> '')"""


_CLEAN = rf"""{_sql_lines('cut', 'raw')},
  tagged as (select *, s in ('Contents', 'Table of Contents') as c,
      s = 'Subject Page' or regexp_matches(s, '^[A-Z][^:]*\.{{3,}}\s*\d+$') as drp,
      regexp_matches(s, '(?i)Shari[''’]ah Standard No\.|^\d+//') as std from raw),
  stated as (select *, last_value(case when drp and not std and not c then null else c end
      ignore nulls) over (partition by doc_id order by pos
      rows between unbounded preceding and 1 preceding) as inside from tagged),
  cleaned as (select doc_id, regexp_replace(string_agg(line, chr(10) order by pos), '\n{{3,}}',
      chr(10) || chr(10), 'g') as text
    from stated where not c and (not drp or (coalesce(inside, false) and std)) group by doc_id)"""

_IS_TOC = (
    r"(regexp_matches({x}, '\.{{3,}}\s*\d+$') or regexp_matches({x}, '^\d+//\d+(?://\d+)?,.*\.{{3,}}\s*\d+')"
    r" or regexp_matches({x}, '^\d+\.\s+.*\.{{3,}}\s*\d+$')"
    r" or regexp_matches({x}, '(?i)^Appendix\s*\([a-z]\):.*\.{{3,}}\s*\d+$')"
    r" or regexp_matches({x}, '^\d+//\d+(?://\d+)?,\d+//\d+(?://\d+)?,.*\.{{3,}}'))"
)
_HEADER = r"^(\d+)(?://(\d+)(?://(\d+))?)?\s+(.+)$"
_ROWS = rf"""{_sql_lines('cleaned', 'lines')},
  typed as (select doc_id, pos, s, regexp_matches(s, '{_HEADER}') as hd,
      regexp_extract(s, '{_HEADER}', 4) as title,
      regexp_extract(s, '{_HEADER}', 1)
        || case when regexp_extract(s, '{_HEADER}', 2) <> '' then '//' || regexp_extract(s, '{_HEADER}', 2) else '' end
        || case when regexp_extract(s, '{_HEADER}', 3) <> '' then '//' || regexp_extract(s, '{_HEADER}', 3) else '' end as path
    from lines where not {_IS_TOC.format(x='s')} and s not in ('Appendices', 'Appendix')
      and not (regexp_matches(s, '^\d+//\d+(?://\d+)?,\d+//\d+(?://\d+)?,')
        and regexp_matches(s, '\.{{3,}}\s*\d+'))),
  kinds as (select *, case when hd and regexp_matches(title, '\.{{3,}}\s*\d+') then 'f'
      when hd then 'h' when s = '' or s = '(Revised Standard)'
        or regexp_matches(s, '(?i)^Shari’ah Standard No\.') then 'x' else 'c' end as kind from typed),
  owned as (select *, last_value(case when kind = 'h' then pos end ignore nulls)
      over (partition by doc_id order by pos rows between unbounded preceding and current row) as sec
    from kinds where kind <> 'x'),
  cuts as (select doc_id, sec, pos as upto from owned where kind = 'f' and sec is not null
    union all select distinct doc_id, sec, 2147483647 from owned where sec is not null),
  all_rows as (select u.doc_id, max(case when o.pos = o.sec then o.path end) as section_number,
      max(case when o.pos = o.sec then o.path end) as section_path,
      string_agg(case when o.kind = 'h' then o.title else o.s end, chr(10) order by o.pos) as content,
      u.sec as line_number
    from cuts u join owned o on o.doc_id = u.doc_id and o.sec = u.sec and o.kind <> 'f'
      and o.pos < u.upto group by u.doc_id, u.sec, u.upto)"""
_SECTION_COLUMNS = """doc_id, section_number, section_path, content,
    len(content) as content_length, line_number"""
_FILTERED = rf"""kept as (select * from all_rows
    where not (len(list_filter(string_split(content, chr(10)), lambda x: {_IS_TOC.format(x='trim(x)')}))
        > len(string_split(content, chr(10))) * 0.5)
      and not {_IS_TOC.format(x='content')})"""
_UP_TO_ROWS = f"with {_SRC}, {_CUT}, {_CLEAN}, {_ROWS}"


def _long(df):
    return df.withColumn("content_length", F.col("content_length").cast("long")).withColumn(
        "line_number", F.col("line_number").cast("long")
    )


@REGISTRY.add("cut_to_first_standard", f"with {_SRC}, {_CUT} select doc_id, text from cut")
def cut_to_first_standard(spark, sf_dir):
    return sec.cut_to_first_standard(_documents(spark, sf_dir))


@REGISTRY.add("drop_contents_lines", f"with {_SRC}, {_CUT}, {_CLEAN} select doc_id, text from cleaned")
def drop_contents_lines(spark, sf_dir):
    return sec.drop_contents_lines(sec.cut_to_first_standard(_documents(spark, sf_dir)))


@REGISTRY.add(
    "toc_entries",
    f"""with {_SRC}, {_sql_lines('src', 'raw')} select doc_id, count(*) as lines,
      count(*) filter (where {_IS_TOC.format(x='s')}) as toc_lines from raw group by doc_id""",
)
def toc_entries(spark, sf_dir):
    stripped = F.transform(lines_of(F.col("text")), strip)
    docs = _documents(spark, sf_dir).select("doc_id", stripped.alias("lines"))
    return docs.select(
        "doc_id",
        F.size("lines").cast("long").alias("lines"),
        F.size(F.filter("lines", sec.is_toc_entry)).cast("long").alias("toc_lines"),
    )


@REGISTRY.add(
    "section_headers",
    rf"""with {_SRC}, {_sql_lines('src', 'raw')}
    select doc_id, pos as line_no, regexp_extract(s, '{_HEADER}', 1) as level1,
      regexp_extract(s, '{_HEADER}', 2) as level2, regexp_extract(s, '{_HEADER}', 3) as level3,
      regexp_extract(s, '{_HEADER}', 4) as title from raw where regexp_matches(s, '{_HEADER}')""",
)
def section_headers(spark, sf_dir):
    lines = F.posexplode(F.transform(lines_of(F.col("text")), strip)).alias("p", "s")
    rows = _documents(spark, sf_dir).select("doc_id", lines)
    return rows.filter(F.regexp_like("s", F.lit(sec.SECTION_HEADER))).select(
        "doc_id",
        (F.col("p") + 1).cast("long").alias("line_no"),
        *[
            F.regexp_extract("s", sec.SECTION_HEADER, g).alias(name)
            for g, name in enumerate(("level1", "level2", "level3", "title"), 1)
        ],
    )


@REGISTRY.add("extract_sections", f"{_UP_TO_ROWS} select {_SECTION_COLUMNS} from all_rows")
def extract_sections(spark, sf_dir):
    cut = sec.cut_to_first_standard(_documents(spark, sf_dir))
    return _long(sec.extract_sections(sec.drop_contents_lines(cut)))


@REGISTRY.add("sectionize", f"{_UP_TO_ROWS}, {_FILTERED} select {_SECTION_COLUMNS} from kept")
def sectionize(spark, sf_dir):
    return _long(sec.sectionize(_documents(spark, sf_dir)))


@REGISTRY.add(
    "corpus_totals",
    f"""{_UP_TO_ROWS}, {_FILTERED} select count(*) as sections,
      sum(len(content))::bigint as total_length from kept""",
)
def corpus_totals(spark, sf_dir):
    return sec.corpus_totals(sec.sectionize(_documents(spark, sf_dir)))


@REGISTRY.add(
    "first_sections",
    f"""{_UP_TO_ROWS}, {_FILTERED} select doc_id, section_number, len(content) as content_length
    from kept order by doc_id, line_number, len(content) limit 10""",
)
def first_sections(spark, sf_dir):
    first = sec.first_sections(sec.sectionize(_documents(spark, sf_dir)))
    return first.withColumn("content_length", F.col("content_length").cast("long"))


@REGISTRY.add(
    "embedding_index",
    f"""{_UP_TO_ROWS}, {_FILTERED} select
      row_number() over (order by doc_id, line_number, len(content)) - 1 as embedding_index,
      'section_' || (row_number() over (order by doc_id, line_number, len(content)) - 1) as id,
      doc_id, line_number from kept""",
)
def embedding_index(spark, sf_dir):
    sections = emb.with_slot(sec.sectionize(_documents(spark, sf_dir)))
    indexed = emb.number_sections(cut_lineage(_long(sections.select("doc_id", "line_number", "content_length", "slot"))))
    index = F.col("embedding_index")
    return indexed.select(
        "embedding_index", emb.section_id(index).alias("id"), "doc_id", "line_number"
    )


# A fold over the lines with an explicit state: 0 before the first standard, 1 normal, 2 contents,
# 3 preface until a statement, 4 preface until a statement or standard. A line's verdict follows it.
_FRONT = rf"""{_sql_lines('src', 'raw')},
  marked as (select doc_id, pos, line, s, lead(s) over (partition by doc_id order by pos) as nxt,
      regexp_matches(s, '(?i)Shari''ah Standard No\.\s*\(\d+\)') as first,
      regexp_matches(s, '(?i)Shari''ah Standard No\.') as named,
      regexp_matches(s, '^\d+//') as num, regexp_matches(s, '(?i)Statement of the Standard') as stm,
      regexp_matches(s, '^[A-Z][^:]*\.{{3,}}\s*\d+$') as ldr,
      s in ('Contents', 'Table of Contents') as c from raw),
  coded as (select doc_id, pos, line, {{'st': 0, 'keep': false, 'first': first, 'c': c,
      'ends_toc': named or num or not (ldr or s = '' or s = 'Subject Page'),
      'stm': stm or num, 'stm4': stm or num or named, 'sub': s = 'Subject Page', 'ldr': ldr,
      'pre': regexp_matches(s, '^Preface\s*\.{{3,}}\s*\d+$'),
      'bare': s = 'Preface' and coalesce(nxt in ('', 'Contents', 'Subject Page'), false)}} as z from marked),
  folded as (select doc_id, list(line order by pos) as ls, list(z order by pos) as zs
    from coded group by doc_id),
  verdicts as (select doc_id, ls, list_transform(generate_series(1, len(zs)), lambda n:
      list_reduce(list_prepend({{'st': 0, 'keep': false, 'first': false, 'c': false,
        'ends_toc': false, 'stm': false, 'stm4': false, 'sub': false, 'ldr': false, 'pre': false,
        'bare': false}}, zs[1:n]), lambda a, b:
        struct_update(b, st := case
            when a.st = 0 then case when b.first then 1 else 0 end
            when (a.st = 3 and not b.stm) or (a.st = 4 and not b.stm4) then a.st
            when b.c then 2 when a.st = 2 and not b.ends_toc then 2
            when a.st = 2 then 1 when b.pre then 3 when b.bare then 4 else 1 end,
          keep := case
            when a.st = 0 then b.first
            when (a.st = 3 and not b.stm) or (a.st = 4 and not b.stm4) then false
            when b.c then false when a.st = 2 then b.ends_toc
            else not (b.pre or b.bare or b.sub or b.ldr) end))) as vs from folded),
  front as (select doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(
      list_zip(ls, vs), lambda q: q[2].keep), lambda q: q[1]), chr(10)),
      '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from verdicts)"""


@REGISTRY.add("remove_front_matter", f"with {_SRC}, {_FRONT} select doc_id, text from front")
def remove_front_matter(spark, sf_dir):
    return front_matter.remove_front_matter(_documents(spark, sf_dir))
