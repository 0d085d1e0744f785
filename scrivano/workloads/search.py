"""Routing, encoding, nearest neighbours, re-ranking and composed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivano.functions import routing, vectors
from scrivano.functions.scoring import CONFUSABLE_TERMS, definition_marks
from scrivano.operators import embedding as emb
from scrivano.operators import knn as nn
from scrivano.operators.rerank import boost_definitions
from scrivano.plans import retrieval
from scrivano.session import scratch_path
from scrivano.sources import readers, vector_files, writers
from scrivano.workloads import Registry, table

REGISTRY = Registry()

DIMENSION = 256

# Queries: every benchmark passage, opened by one of several phrases.
_ASKED = """case item_id % 9 when 0 then 'What is ' when 1 then 'List the rules for '
  when 2 then 'Is it forbidden: ' when 3 then 'Compare ' when 4 then '' when 5 then 'Define '
  when 6 then 'How to do why? ' when 7 then 'Meaning of ' else 'definition of salam? ' end || text"""


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.expr(_ASKED).alias("query")
    )


_SQL_QUERIES = f"queries as (select item_id as query_id, {_ASKED} as query from benchmark)"


def _list(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _any(column, words):
    return f"len(list_filter({_list(words)}, lambda k: contains({column}, k))) > 0"


_SQL_ROUTES = rf"""low as (select query_id, query, lower(query) as q from queries),
  typed as (select *, case when {_any('q', routing.DEFINITION_KEYWORDS)} then 'definition'
      when {_any('q', routing.RULES_KEYWORDS)} then 'rules'
      when {_any('q', routing.PROHIBITION_KEYWORDS)} then 'prohibition'
      when {_any('q', routing.COMPARISON_KEYWORDS)} then 'comparison' end as matched,
    list_filter(string_split_regex(query, '\s+'), lambda w: w <> '') as words from low),
  scored as (select *, case when matched = 'comparison' then 0.8::double else least(
      least(len(query) / 200.0::double, 1.0::double) * 0.3::double
      + least(len(string_split_regex(query, '[.!?]')) / 5.0::double, 1.0::double) * 0.2::double
      + least(len(list_filter({_list(routing.QUESTION_WORDS)}, lambda k: contains(q, k)))
          / 3.0::double, 1.0::double) * 0.2::double
      + greatest(least((case when len(words) > 0 then list_sum(list_transform(words,
          lambda w: len(w))) / len(words)::double else 0.0::double end - 4) / 5.0::double,
          1.0::double) * 0.3::double, 0.0::double), 1.0::double) end as complexity from typed),
  named as (select *, case when matched = 'comparison' then 'complex' when matched is not null
      then matched when complexity > 0.6 then 'complex' else 'simple' end as query_type from scored),
  routes as (select query_id, query, query_type, complexity, query_type <> 'simple' as expansion,
      case when complexity > 0.7 then least(base + 2, 15) else base end as n_results,
      query_type = 'definition' as boost, complexity > 0.7 or query_type = 'complex' as rerank
    from (select *, case query_type when 'rules' then 7 when 'prohibition' then 5
      when 'complex' then 10 else 3 end as base from named))"""


@REGISTRY.add(
    "route_queries",
    f"""with {_SQL_QUERIES}, {_SQL_ROUTES} select query_id, query_type,
      round(complexity, 6) as complexity, expansion, n_results, boost, rerank from routes""",
)
def route_queries(spark, sf_dir):
    return retrieval.route(_queries(spark, sf_dir)).select(
        "query_id",
        "query_type",
        F.round("complexity", 6).alias("complexity"),
        F.col("strategy.use_query_expansion").alias("expansion"),
        F.col("strategy.n_results").alias("n_results"),
        F.col("strategy.boost_definitions").alias("boost"),
        F.col("strategy.rerank").alias("rerank"),
    )


_SPOKEN_SQL = """queries as (select conv_id * 100 + turn as query_id, text as query
    from conversations)"""


@REGISTRY.add(
    "route_messages",
    f"""with {_SPOKEN_SQL}, {_SQL_ROUTES} select query_type, n_results, rerank,
      count(*) as queries, round(avg(complexity), 6) as mean_complexity
    from routes group by query_type, n_results, rerank""",
)
def route_messages(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select(F.col("text").alias("query"))
    routed = retrieval.route(messages)
    return routed.groupBy(
        "query_type",
        F.col("strategy.n_results").alias("n_results"),
        F.col("strategy.rerank").alias("rerank"),
    ).agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg("complexity"), 6).alias("mean_complexity"),
    )


_ASKS = r"(?:what is|what are|define|definition of|explain|meaning of)\s+([^?]+)"


@REGISTRY.add(
    "expand_queries",
    rf"""with {_SQL_QUERIES}, matched as (select query_id, query,
      {_any('lower(query)', routing.EXPANSION_PHRASES)}
        and regexp_matches(lower(query), '{_ASKS}') as hit,
      regexp_replace(regexp_extract(lower(query), '{_ASKS}', 1), '^\s+|\s+$', '', 'g') as t
      from queries), listed as (select query_id, case when hit then [query, 'Definition of ' || t,
        t || ' definition', t || ' is', t || ' means', 'Concept of ' || t] else [query] end as v
      from matched)
    select query_id, generate_subscripts(v, 1) - 1 as variant_no, unnest(v) as query from listed""",
)
def expand_queries(spark, sf_dir):
    variants = retrieval.expand(_queries(spark, sf_dir))
    return variants.withColumn("variant_no", F.col("variant_no").cast("long"))


@REGISTRY.add(
    "definition_intent",
    f"""with {_SQL_QUERIES} select query_id, {_any('lower(query)', routing.INTENT_PHRASES)}
      as wants_definition from queries""",
)
def definition_intent(spark, sf_dir):
    return _queries(spark, sf_dir).select(
        "query_id", routing.has_definition_intent(F.col("query")).alias("wants_definition")
    )


_BLANKED = "case when turn % 3 = 2 then chr(9) || ' ' || chr(10) else text end"


@REGISTRY.add(
    "drop_blank_queries",
    f"""select conv_id, turn, {_BLANKED} as query from conversations
    where regexp_matches({_BLANKED}, '\\S')""",
)
def drop_blank_queries(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(_BLANKED).alias("query")
    )
    return retrieval.drop_blank(messages)


def _unsigned_zero(value):
    """Rounding may leave a negative zero, which engines print differently."""
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


_SQL_UNSIGNED = "case when {x} = 0 then 0.0::double else {x} end"


# Encoding --------------------------------------------------------------------------------------

_MODEL = "case when doc_id % 2 = 0 then 'BAAI/BGE-small' else 'other-model' end"


@REGISTRY.add(
    "instruction_prefix",
    f"""select doc_id, case when doc_id % 2 = 0 then '{emb.INSTRUCTION} ' || text else text end
    as input from documents""",
)
def instruction_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", emb.with_instruction(F.col("text"), F.expr(_MODEL)).alias("input")
    )


# MurmurHash3 (32 bit, seed 42) of each distinct word's UTF-8 bytes, as the hashing encoder uses.
_MASK = 4294967296


def _rotl(x, r):
    return f"((({x}) << {r}) % {_MASK} | (({x}) >> {32 - r}))"


def _mix_k(k):
    first = f"(({k}) * 3432918353::ubigint) % {_MASK}"
    return f"({_rotl(first, 15)} * 461845907::ubigint) % {_MASK}"


def _sql_vectors(source, key, text, name):
    """Sparse unit vectors of ``text``: (key, bucket, value) with single-precision values."""
    mixed = f"xor(h, {_mix_k('w')})"
    return rf"""{name}_words as (select {key}, unnest(regexp_extract_all(lower({text}),
      '[\p{{L}}\p{{N}}]+')) as word from {source}),
  {name}_hex as (select word, lower(hex(encode(word))) as hx from (select distinct word from {name}_words)),
  {name}_bytes as (select word, list_transform(generate_series(0, len(hx) // 2 - 1),
      lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::ubigint) as b from {name}_hex),
  {name}_blocks as (select word, len(b)::ubigint as n, list_transform(generate_series(0, len(b) // 4 - 1),
      lambda i: b[4*i+1] + b[4*i+2] * 256 + b[4*i+3] * 65536 + b[4*i+4] * 16777216) as ws,
      coalesce(list_sum(list_transform(generate_series(0, len(b) % 4 - 1),
        lambda i: b[(len(b) // 4) * 4 + i + 1] * (1::ubigint << (8 * i)))), 0)::ubigint as tail from {name}_bytes),
  {name}_body as (select word, n, tail, list_reduce(list_prepend(42::ubigint, ws), lambda h, w:
      ({_rotl(mixed, 13)} * 5 + 3864292196::ubigint) % {_MASK}) as h from {name}_blocks),
  {name}_f1 as (select word, xor(xor(h, {_mix_k('tail')}), n) as h from {name}_body),
  {name}_f2 as (select word, (xor(h, h >> 16) * 2246822507::ubigint) % {_MASK} as h from {name}_f1),
  {name}_f3 as (select word, (xor(h, h >> 13) * 3266489909::ubigint) % {_MASK} as h from {name}_f2),
  {name}_hash as (select word, (xor(h, h >> 16) % {DIMENSION})::bigint as bucket from {name}_f3),
  {name}_counts as (select {key}, bucket, count(*)::double as n from {name}_words join {name}_hash
      using (word) group by {key}, bucket),
  {name} as (select {key}, bucket, (n / sqrt(sum(n * n) over (partition by {key})))::float::double
      as value from {name}_counts)"""


def _encoded(df, text, model="hashed"):
    return emb.embed(df, text, model, dimension=DIMENSION)


@REGISTRY.add(
    "hash_encode",
    f"""with {_sql_vectors('documents', 'doc_id', 'text', 'vec')}
    select doc_id, bucket, round(value, 6) as value from vec""",
)
def hash_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    entries = F.posexplode_outer("embedding").alias("bucket", "value")
    return (
        _encoded(docs, "text")
        .select("doc_id", entries)
        .filter(F.col("value") != 0)
        .select(
            "doc_id",
            F.col("bucket").cast("long").alias("bucket"),
            F.round(F.col("value").cast("double"), 6).alias("value"),
        )
    )


@REGISTRY.add(
    "l2_normalize",
    f"""with scaled as (select vec_id, list_transform(embedding, lambda x:
      (x * (vec_id % 5)::float)::double) as v from embeddings),
    lengths as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from scaled),
    units as (select vec_id, unnest(list_transform(v, lambda x:
      round((case when n > 0 then x / n else x end)::float::double, 5))) as value,
      generate_subscripts(v, 1) as place from lengths)
    select vec_id, {_SQL_UNSIGNED.format(x='value')} as value, place from units""",
)
def l2_normalize(spark, sf_dir):
    factor = (F.col("vec_id") % 5).cast("float")
    scaled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x * factor).alias("v")
    )
    unit = F.posexplode(vectors.l2_normalize(F.col("v"))).alias("p", "x")
    return scaled.select("vec_id", unit).select(
        "vec_id",
        _unsigned_zero(F.round(F.col("x").cast("double"), 5)).alias("value"),
        (F.col("p") + 1).cast("long").alias("place"),
    )


@REGISTRY.add(
    "embedding_manifest",
    """select 'hashed' as model_name, max(len(embedding)) as embedding_dimension,
      count(*) as num_embeddings from embeddings""",
)
def embedding_manifest(spark, sf_dir):
    return emb.manifest(table(spark, sf_dir, "embeddings"), "hashed").withColumn(
        "embedding_dimension", F.col("embedding_dimension").cast("long")
    )


@REGISTRY.add(
    "embedding_throughput",
    """select count(*) as texts, count(*) / 8.0::double as texts_per_second,
      sum(len(embedding) * 4) / 1048576.0::double as megabytes from embeddings""",
)
def embedding_throughput(spark, sf_dir):
    return emb.throughput(table(spark, sf_dir, "embeddings"), 8.0)


@REGISTRY.add(
    "alignment_counts",
    """select count(*) filter (where e.vec_id is null) as only_dataset,
      count(*) filter (where d.doc_id is null) as only_embeddings
    from documents d full outer join embeddings e on e.vec_id = d.doc_id""",
)
def alignment_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("embedding_index"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("embedding_index"))
    return emb.unmatched_counts(docs, vecs)


# Nearest neighbours ------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    collection = vecs.select(F.col("vec_id").alias("embedding_index"), "embedding", "label")
    queries = vecs.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return collection, queries


def _rounded(hits):
    return hits.select(
        "query_id",
        "embedding_index",
        F.col("rank").cast("long").alias("rank"),
        _unsigned_zero(F.round("distance", 5)).alias("distance"),
    )


def _sql_distance(metric, a="a.embedding", b="b.embedding"):
    pairs = f"list_zip({a}, {b})"
    if metric == "sqeuclidean":
        term = "(z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)"
        return f"list_sum(list_transform({pairs}, lambda z: {term}))::float::double"
    dot = f"list_sum(list_transform({pairs}, lambda z: z[1]::double * z[2]::double))"
    if metric == "ip":
        return f"(1 - {dot})::float::double"
    length = "sqrt(list_sum(list_transform({x}, lambda y: y::double * y::double)))"
    return f"(1 - {dot} / ({length.format(x=a)} * {length.format(x=b)}))::float::double"


def _sql_knn(k, metric="sqeuclidean"):
    return f"""with pairs as (select b.vec_id as query_id, a.vec_id as embedding_index,
      {k} as k, {_sql_distance(metric)} as distance from embeddings a cross join embeddings b),
    ranked as (select *, row_number() over (partition by query_id
      order by distance, embedding_index) as rank from pairs)
    select query_id, embedding_index, rank,
      {_SQL_UNSIGNED.format(x='round(distance, 5)')} as distance from ranked where rank <= k"""


@REGISTRY.add("knn_topk", _sql_knn(5))
def knn_topk(spark, sf_dir):
    collection, queries = _vectors(spark, sf_dir)
    return _rounded(nn.knn(collection, queries, 5))


# Small tiles and splits, so that the given tables fill many of them.
@REGISTRY.add("knn_cells", _sql_knn(5))
def knn_cells(spark, sf_dir):
    collection, queries = _vectors(spark, sf_dir)
    return _rounded(nn.knn(collection, queries, 5, plan="tiles", tile_bytes=64 << 10, split_rows=128))


@REGISTRY.add("knn_cosine", _sql_knn(3, "cosine"))
def knn_cosine(spark, sf_dir):
    collection, queries = _vectors(spark, sf_dir)
    return _rounded(nn.knn(collection, queries, 3, "cosine"))


@REGISTRY.add("knn_inner_product", _sql_knn(3, "ip"))
def knn_inner_product(spark, sf_dir):
    collection, queries = _vectors(spark, sf_dir)
    return _rounded(nn.knn(collection, queries, 3, "ip"))


@REGISTRY.add("knn_variable_k", _sql_knn("b.label"))
def knn_variable_k(spark, sf_dir):
    collection, queries = _vectors(spark, sf_dir)
    return _rounded(nn.knn(collection, queries, "label"))


_HYPERPLANE = "((31 * i + 17 * j + 7) * (j + 3) * (i + 11) * 40503 + 12289 * i) % 65521 % 2 = 1"
_SQL_APPROXIMATE = f"""planes as (select j, list(case when {_HYPERPLANE} then 1.0::double else -1.0::double end order by i) as s
      from range(64) a(i), range({nn.TABLES * nn.BITS}) b(j) group by j),
    codes as (select vec_id, j // {nn.BITS} as tab, sum(case when list_inner_product(embedding::double[], s) > 0
      then 1 << (j % {nn.BITS})::int else 0 end)::int as code from embeddings, planes group by 1, 2),
    met as (select distinct q.vec_id as query_id, c.vec_id as embedding_index from codes q join codes c
      on q.tab = c.tab and bit_count(xor(q.code, c.code)) <= {nn.FLIPS}),
    near as (select m.*, {_sql_distance('sqeuclidean')} as distance from met m
      join embeddings a on a.vec_id = m.embedding_index join embeddings b on b.vec_id = m.query_id),
    hits as (select *, row_number() over (partition by query_id order by distance, embedding_index) as rank
      from near qualify rank <= 5)"""


@REGISTRY.add(
    "knn_approximate",
    f"""with {_SQL_APPROXIMATE} select query_id, embedding_index, rank,
      {_SQL_UNSIGNED.format(x='round(distance, 5)')} as distance from hits""",
)
def knn_approximate(spark, sf_dir):
    collection, queries = _vectors(spark, sf_dir)
    return _rounded(nn.ApproximateStore(collection).query(queries, 5))


@REGISTRY.add(
    "knn_recall",
    f"""with {_SQL_APPROXIMATE}, exact as ({_sql_knn(5)})
    select count(*) as wanted, count(h.query_id) as found, count(h.query_id) / count(*) as recall
    from exact e left join hits h on h.query_id = e.query_id and h.embedding_index = e.embedding_index""",
)
def knn_recall(spark, sf_dir):
    collection, queries = _vectors(spark, sf_dir)
    return nn.recall(nn.ApproximateStore(collection).query(queries, 5), nn.knn(collection, queries, 5))


@REGISTRY.add(
    "distance_metrics",
    f"""select b.vec_id as query_id, round({_sql_distance('sqeuclidean')}, 5) as sqeuclidean,
      round({_sql_distance('cosine')}, 5) as cosine, round({_sql_distance('ip')}, 5) as ip
    from embeddings a join embeddings b on a.vec_id = b.vec_id + 1""",
)
def distance_metrics(spark, sf_dir):
    collection, queries = _vectors(spark, sf_dir)
    nexts = collection.select(
        (F.col("embedding_index") - 1).alias("query_id"), F.col("embedding").alias("other")
    )
    pair = queries.join(nexts, "query_id")
    return pair.select(
        "query_id",
        *[
            F.round(vectors.distance(F.col("other"), F.col("embedding"), m), 5).alias(m)
            for m in vectors.METRICS
        ],
    )


# Re-ranking and composed retrieval over the documents --------------------------------------------

_CONTENT = """case doc_id % 6 when 0 then 'Definition: ' || text when 1 then 'This means ' || text
  when 2 then 'Mudarabah and ' || text when 3 then 'mudarabah or murabahah ' || text
  when 4 then 'What it refers to ' || text else text end"""


def _sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.select(
        F.col("doc_id").alias("embedding_index"),
        F.expr(_CONTENT).alias("content"),
        F.col("lang").alias("section_number"),
        F.when(F.col("doc_id") % 5 != 0, F.expr("lang || '//' || (doc_id % 7)")).alias("section_path"),
        F.when(F.col("doc_id") % 4 != 0, F.expr("length(text)")).alias("content_length"),
        F.lit(1).alias("line_number"),
    )


def _collection(spark, sf_dir):
    return emb.build_collection(_encoded(_sections(spark, sf_dir), "content"))


def _embedder(queries):
    return _encoded(queries, "query")


_SQL_SECTIONS = f"""sections as (select doc_id, {_CONTENT} as content, lang as section_number,
    case when doc_id % 5 <> 0 then lang || '//' || (doc_id % 7) end as section_path,
    case when doc_id % 4 <> 0 then len(text) end as content_length from documents)"""

# Distances of sparse vectors from norms and common buckets; words that share no bucket count too.
_SQL_PAIRS = f"""{_sql_vectors('sections', 'doc_id', 'content', 'dv')},
  {_sql_vectors('queries', 'query_id', 'query', 'qv')},
  dn as (select s.doc_id, coalesce(sum(value * value), 0) as n from sections s
    left join dv on dv.doc_id = s.doc_id group by s.doc_id),
  qn as (select q.query_id, coalesce(sum(value * value), 0) as n from queries q
    left join qv on qv.query_id = q.query_id group by q.query_id),
  dots as (select query_id, doc_id, sum(qv.value * dv.value) as dot from qv join dv
    on qv.bucket = dv.bucket group by query_id, doc_id),
  pairs as (select qn.query_id, dn.doc_id, (qn.n + dn.n - 2 * coalesce(dot, 0))::float::double
      as distance from qn cross join dn left join dots
      on dots.query_id = qn.query_id and dots.doc_id = dn.doc_id),
  placed as (select *, row_number() over (partition by query_id order by distance, doc_id) as place
    from pairs)"""


def _sql_score(topics):
    topic = """+ case when contains(lower(content), 'mudarabah')
      and not contains(lower(content), 'murabahah') then 0.15::double else 0.0::double end"""
    return f"""(distance - case when contains(lower(content), 'definition')
      then 0.2::double else 0.0::double end
    - case when contains(lower(content), ' is ')
        or contains(lower(content), ' means ')
        or contains(lower(content), ' refers to ')
      then 0.1::double else 0.0::double end {topic if topics else ''})"""


_HIT_COLUMNS = """query_id, rank, 'section_' || doc_id as id, section_number,
    coalesce(section_path, '') as section_path, content, round(distance, 5) as distance,
    round(1 - distance, 5) as relevance_score, coalesce(content_length, len(content)) as content_length"""


def _hits(hits):
    return hits.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "id",
        "section_number",
        "section_path",
        "content",
        F.round("distance", 5).alias("distance"),
        F.round("relevance_score", 5).alias("relevance_score"),
        F.col("content_length").cast("long").alias("content_length"),
    )


_SQL_RETRIEVE = f"""{_SQL_QUERIES}, {_SQL_SECTIONS}, {_SQL_ROUTES}, {_SQL_PAIRS},
  fetched as (select p.*, s.content, s.section_number, s.section_path, s.content_length,
      case when boost then {_sql_score(False)} else distance end as score
    from placed p join routes r on r.query_id = p.query_id
    join sections s on s.doc_id = p.doc_id where place <= n_results),
  hits as (select *, row_number() over (partition by query_id order by score, place) as rank
    from fetched)"""


@REGISTRY.add("retrieve_routed", f"with {_SQL_RETRIEVE} select {_HIT_COLUMNS} from hits")
def retrieve_routed(spark, sf_dir):
    return _hits(
        retrieval.retrieve(_queries(spark, sf_dir), _collection(spark, sf_dir), _embedder)
    )


# Routing off: all queries get the same number of hits and no boost. An own router: by the query's number.
def _sql_own(boost, n):
    own = _SQL_RETRIEVE.replace("case when boost then", f"case when {boost} then")
    return own.replace("where place <= n_results", f"where place <= {n}")


@REGISTRY.add(
    "retrieve_unrouted",
    f"with {_sql_own('false', '6')} select {_HIT_COLUMNS} from hits",
)
def retrieve_unrouted(spark, sf_dir):
    queries, collection = _queries(spark, sf_dir), _collection(spark, sf_dir)
    return _hits(retrieval.retrieve(queries, collection, _embedder, router=None, n_results=6))


@REGISTRY.add(
    "retrieve_own_router",
    f"with {_sql_own('p.query_id % 2 = 0', '1 + p.query_id % 4')} select {_HIT_COLUMNS} from hits",
)
def retrieve_own_router(spark, sf_dir):
    def by_number(queries):
        plan = F.struct(
            (F.col("query_id") % 4 + 1).cast("int").alias("n_results"), (F.col("query_id") % 2 == 0).alias("boost_definitions")
        )
        return queries.withColumn("strategy", plan)

    queries, collection = _queries(spark, sf_dir), _collection(spark, sf_dir)
    return _hits(retrieval.retrieve(queries, collection, _embedder, router=by_number))


@REGISTRY.add("retrieve_bucketed", f"with {_SQL_RETRIEVE} select {_HIT_COLUMNS} from hits")
def retrieve_bucketed(spark, sf_dir):
    """Routed retrieval over a collection that is bucketed by its unique index, without broadcast winners."""
    path = scratch_path(spark, "bucketed")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    collection = writers.write_bucketed(_collection(spark, sf_dir), name, path, 8)
    hits = retrieval.retrieve(_queries(spark, sf_dir), collection, _embedder, unique=True, max_hits=0)
    return _hits(hits)


# Letters, vowels and spaces of a text, as an encoder would return them.
_COUNTED = ("[^ ]", "[aeiou]", " ")


def _counting_encoder():
    import re

    patterns = [re.compile(p) for p in _COUNTED]
    return lambda texts: [[len(p.findall(t)) for p in patterns] + [1] for t in texts]


@REGISTRY.add(
    "pluggable_encoder",
    f"""with counted as (select doc_id, [{', '.join(f"len(regexp_extract_all(text, '{p}'))::double" for p in _COUNTED)}, 1.0::double] as v
      from documents), lengths as (select *, sqrt(list_inner_product(v, v)) as n from counted)
    select doc_id, generate_subscripts(v, 1) as place, round((unnest(v) / n)::float::double, 5) as value from lengths""",
)
def pluggable_encoder(spark, sf_dir):
    """Documents encoded by an own model, written with their manifest and joined back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("embedding_index"), F.col("text").alias("content"))
    encoded = emb.embed(docs, "content", "own-model", _counting_encoder)
    vectors_at, sections_at, about = (scratch_path(spark, x) for x in ("own-vectors", "own-sections", "own-about"))
    writers.write_embeddings(encoded, vectors_at, sections_at, about, "own-model")
    back = readers.read_embedded_sections(spark, sections_at, vectors_at)
    return back.select(F.col("embedding_index").alias("doc_id"), F.posexplode("embedding").alias("p", "x")).select(
        "doc_id", (F.col("p") + 1).cast("long").alias("place"), F.round(F.col("x").cast("double"), 5).alias("value")
    )


def _file_store(spark, sf_dir):
    collection, queries = _vectors(spark, sf_dir)
    path = scratch_path(spark, "vector-files")
    vector_files.write_vectors(collection.select("embedding_index", "embedding"), path)
    return retrieval.FileStore(spark, path), queries


@REGISTRY.add("file_store_search", _sql_knn(5))
def file_store_search(spark, sf_dir):
    """The same search over the second kind of collection."""
    store, queries = _file_store(spark, sf_dir)
    return _rounded(store.query(queries, 5))


@REGISTRY.add(
    "store_counts",
    """select 'parquet' as store, count(*) as vectors from embeddings union all
      select 'files', count(*) from embeddings""",
)
def store_counts(spark, sf_dir):
    collection, _ = _vectors(spark, sf_dir)
    files, _ = _file_store(spark, sf_dir)
    counts = [("parquet", nn.ExactStore(collection).count()), ("files", files.count())]
    return spark.createDataFrame(counts, "store string, vectors long")


def _sql_search(n, expansion=True, name="hits", mapped="true"):
    fetch = f"2 * {n}" if expansion else str(n)
    wants = _any("lower(query)", routing.INTENT_PHRASES) if expansion else "false"
    return f"""fetched as (select p.*, s.content, s.section_number, s.section_path,
      s.content_length, case when {wants} then {_sql_score(True)} else distance end as score
    from placed p join queries q on q.query_id = p.query_id
    join sections s on s.doc_id = p.doc_id where place <= {fetch} and {mapped}),
  boosted as (select *, row_number() over (partition by query_id order by score, place) as rank
    from fetched), {name} as (select * from boosted where rank <= {n})"""


_SQL_BASE = f"{_SQL_QUERIES}, {_SQL_SECTIONS}, {_SQL_PAIRS}"


@REGISTRY.add(
    "search_over_fetching", f"with {_SQL_BASE}, {_sql_search(5)} select {_HIT_COLUMNS} from hits"
)
def search_over_fetching(spark, sf_dir):
    return _hits(retrieval.search(_queries(spark, sf_dir), _collection(spark, sf_dir), _embedder))


@REGISTRY.add(
    "search_over_fetch_ceiling",
    f"""with {_SQL_BASE}, {_sql_search(25)} select query_id, count(*) as hits,
      max(rank) as last_rank from hits group by query_id""",
)
def search_over_fetch_ceiling(spark, sf_dir):
    hits = retrieval.search(
        _queries(spark, sf_dir), _collection(spark, sf_dir), _embedder, n_results=25
    )
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.max("rank").cast("long").alias("last_rank")
    )


@REGISTRY.add(
    "search_without_expansion",
    f"with {_SQL_BASE}, {_sql_search(4, False)} select {_HIT_COLUMNS} from hits",
)
def search_without_expansion(spark, sf_dir):
    return _hits(
        retrieval.search(
            _queries(spark, sf_dir),
            _collection(spark, sf_dir),
            _embedder,
            n_results=4,
            use_expansion=False,
        )
    )


# Every fifth position of the bare index has no mapping to a section.
@REGISTRY.add(
    "search_flat_index",
    f"""with {_SQL_BASE}, {_sql_search(6, mapped='p.doc_id % 5 <> 2')}
    select {_HIT_COLUMNS} from hits""",
)
def search_flat_index(spark, sf_dir):
    encoded = _encoded(_sections(spark, sf_dir), "content")
    index = encoded.select((F.col("embedding_index") * 3 + 1).alias("position"), "embedding")
    mapping = (
        table(spark, sf_dir, "documents")
        .select(
            (F.col("doc_id") * 3 + 1).alias("position"), F.col("doc_id").alias("embedding_index")
        )
        .filter(F.col("embedding_index") % 5 != 2)
    )
    return _hits(
        retrieval.search_flat(
            _queries(spark, sf_dir), index, mapping, _sections(spark, sf_dir), _embedder, 6
        )
    )


def _label_hits(spark, sf_dir, derive=None):
    """Hits of every vector among all vectors, with the document of the same number as text, or what is derived from it."""
    collection, queries = _vectors(spark, sf_dir)
    # Labels join while rows are small: texts move once less.
    nearest = nn.knn(collection, queries, 8).join(queries.select("query_id", "label"), "query_id")
    texts = _sections(spark, sf_dir).select("embedding_index", "content")
    return nn.fetch_hits(nearest, texts, "content", max_hits=nn.hit_rows(queries, 8), derive=derive)


def _marked_hits(spark, sf_dir):
    """These hits with the marks that decide the boost; the texts stay where they are."""
    return _label_hits(spark, sf_dir, {"marks": definition_marks(F.col("content"), CONFUSABLE_TERMS)})


_SQL_LABEL_HITS = f"""{_SQL_SECTIONS}, pairs as (select b.vec_id as query_id, a.vec_id as doc_id,
      b.label, {_sql_distance('sqeuclidean')} as distance from embeddings a cross join embeddings b),
    ranked as (select *, row_number() over (partition by query_id order by distance, doc_id)
      as place from pairs),
    near as (select r.*, s.content from ranked r join sections s on s.doc_id = r.doc_id
      where place <= 8)"""


def _sql_boost(score):
    return f"""with {_SQL_LABEL_HITS} select query_id, doc_id as embedding_index,
      row_number() over (partition by query_id order by {score}, place) as rank,
      round(distance, 5) as distance from near"""


@REGISTRY.add("boost_definitions", _sql_boost(_sql_score(False)))
def boost_all_definitions(spark, sf_dir):
    return _rounded(boost_definitions(_marked_hits(spark, sf_dir), marks="marks"))


@REGISTRY.add("boost_with_topic_penalty", _sql_boost(_sql_score(True)))
def boost_with_topic_penalty(spark, sf_dir):
    return _rounded(boost_definitions(_marked_hits(spark, sf_dir), topic_penalties=True, marks="marks"))


@REGISTRY.add(
    "boost_conditionally",
    _sql_boost(f"case when label % 2 = 0 then {_sql_score(False)} else distance end"),
)
def boost_conditionally(spark, sf_dir):
    return _rounded(boost_definitions(_marked_hits(spark, sf_dir), F.col("label") % 2 == 0, marks="marks"))
