"""Feature queries: weighted words, counts, term hits, word and document vectors, and the scaled matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions import lexicon
from wardlens.functions import scalars as S
from wardlens.operators import dataset as D
from wardlens.operators import features as V
from wardlens.operators import relations as R
from wardlens.operators import vectors as W
from wardlens.plans import corpus as K
from wardlens.plans.registry import materialized, query, with_ctes, with_views
from wardlens.plans.text_queries import LCS_SQL, SPLIT_SQL
from wardlens.plans.text_queries import notes as note_texts
from wardlens.session import KEYED_BYTES, materialize
from wardlens.sources import files
from wardlens.sources.tables import read_table

MAX_FEATURES = MATRIX_WORDS = 10_000
SEQUENCE_LENGTH = 2500
CAP = W.AVERAGE_CAP
DIM = K.VECTOR_WIDTH


def r6(value: Column | str) -> Column:
    return F.round(value, 6) + F.lit(0.0)


def word_counts(docs: DataFrame) -> DataFrame:
    return V.token_counts(docs, "doc_id", S.vector_tokens("text"))


COUNTS_SQL = K.counts_sql("counts", tokens=K.sql_tokens("text"))
SPLIT_DOCS_SQL = f"split_docs as (select doc_id, text, {SPLIT_SQL.format('doc_id')} as split from documents)"
FIT_SQL = [
    SPLIT_DOCS_SQL,
    "fit_docs as (select * from split_docs where split in ('train', 'val'))",
    COUNTS_SQL,
    "fit_counts as (select c.* from counts c join fit_docs f on c.doc_id = f.doc_id)",
]


def weights_sql(name: str, vocab: str, counts: str, n_docs: str, smooth: bool, sublinear: bool) -> str:
    idf = f"ln((1 + {n_docs}) / (1 + v.df)) + 1" if smooth else f"ln({n_docs} / v.df) + 1"
    tf = "(1 + ln(c.tf))" if sublinear else "c.tf"
    return f"""
{name}_raw as (
  select c.doc_id, c.token, v.idx, {tf} * ({idf}) as w from {counts} c join {vocab} v on c.token = v.token),
{name} as (
  select r.doc_id, r.token, r.idx, r.w / n.length as value
  from {name}_raw r join (select doc_id, sqrt(sum(w * w)) as length from {name}_raw group by 1) n on r.doc_id = n.doc_id)"""


# --- words -------------------------------------------------------------------------------------------------

@query(
    "top_vocabulary", "L5 F17",
    with_ctes(COUNTS_SQL, K.vocab_sql("vocab", "counts", MAX_FEATURES)) + "select token, idx, cf, df from vocab",
)
def top_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return V.top_vocab(word_counts(K.keyed_documents(spark, sf)), MAX_FEATURES)


@query(
    "tfidf_weights", "V1 D4 L5",
    with_ctes(
        *FIT_SQL,
        K.vocab_sql("vocab", "fit_counts", MAX_FEATURES),
        weights_sql("weights", "vocab", "counts", "(select count(*) from fit_docs)", smooth=False, sublinear=True),
    ) + "select doc_id, token, idx, round(value, 6) as value from weights",
)
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on train and validation documents, applied to all."""
    docs = D.split_dataset(K.keyed_documents(spark, sf), "doc_id")
    counts = V.token_counts(docs, ["doc_id", "split"], S.vector_tokens("text"))
    vocab = V.tfidf_fit(D.fit_rows(counts), V.document_count(D.fit_rows(docs), "doc_id"), MAX_FEATURES)
    return V.tfidf_transform(counts, vocab, "doc_id").withColumn("value", r6("value"))


@query(
    "smooth_idf", "V2",
    with_ctes(COUNTS_SQL) + """
select token, df, round(ln((1 + (select count(*) from documents)) / (1 + df)) + 1, 6) as idf
from (select token, count(*) as df from counts group by 1)""",
)
def smooth_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = K.documents(spark, sf)
    frequencies = V.document_frequency(docs, "doc_id", S.vector_tokens("text")).filter(
        ~F.col("token").isin(lexicon.ENGLISH_STOP_WORDS)
    )
    return V.idf_table(frequencies, V.document_count(docs, "doc_id")).withColumn("idf", r6("idf"))


@query(
    "bag_of_words", "V4 L5",
    with_ctes(COUNTS_SQL, K.vocab_sql("vocab", "counts", MAX_FEATURES)) + """
select c.doc_id, c.token, v.idx, cast(c.tf as double) as value from counts c join vocab v on c.token = v.token""",
)
def bag_of_words(spark: SparkSession, sf: str) -> DataFrame:
    counts = word_counts(K.keyed_documents(spark, sf))
    return V.bow_transform(counts, V.top_vocab(counts, MAX_FEATURES), "doc_id")


@query(
    "tfidf_from_counts", "V5",
    with_ctes(
        COUNTS_SQL,
        K.vocab_sql("vocab", "counts"),
        weights_sql("weights", "vocab", "counts", "(select count(*) from documents)", smooth=True, sublinear=False),
    ) + "select doc_id, token, idx, round(value, 6) as value from weights",
)
def tfidf_from_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = K.keyed_documents(spark, sf)
    weights = V.tfidf_from_counts(word_counts(docs), V.document_count(docs, "doc_id"), "doc_id")
    return weights.withColumn("value", r6("value"))


# --- term hits ---------------------------------------------------------------------------------------------

@query(
    "term_features", "S7",
    """
select lower(r_name) as term, concat('HP_', lower(r_name)) as feature from region
union all select lower(n_name), concat('HP_', lower(n_name)) from nation""",
)
def term_features(spark: SparkSession, sf: str) -> DataFrame:
    names = read_table(spark, sf, "region").select(F.lower("r_name").alias("term")).unionByName(
        read_table(spark, sf, "nation").select(F.lower("n_name").alias("term"))
    )
    return files.load_terms(names)


def hits_sql(terms: list[str], text: str = "text") -> str:
    return "\nunion all\n".join(
        f"select doc_id, {K.quoted(t)} as term, len(regexp_extract_all({text}, {K.quoted(t)})) as value from documents"
        for t in terms
    )


@query("hotspot_counts", "V6 J10 F13", f"select * from ({hits_sql(K.TERMS)}) where value > 0")
def hotspot_counts(spark: SparkSession, sf: str) -> DataFrame:
    hits = V.hotspot_counts(K.documents(spark, sf), "doc_id", "text", K.TERMS)
    return hits.withColumn("value", F.col("value").cast("bigint"))


@query("hotspot_counts_with_zeros", "V6", hits_sql(K.TERMS))
def hotspot_counts_with_zeros(spark: SparkSession, sf: str) -> DataFrame:
    hits = V.hotspot_counts(K.documents(spark, sf), "doc_id", "text", K.TERMS, keep_zeros=True)
    return hits.withColumn("value", F.col("value").cast("bigint"))


@query("term_table_matches", "J10 V6", f"select * from ({hits_sql(K.TERMS)}) where value > 0")
def term_table_matches(spark: SparkSession, sf: str) -> DataFrame:
    hits = V.match_terms(K.documents(spark, sf), "doc_id", "text", K.terms(spark))
    return hits.withColumn("value", F.col("value").cast("bigint"))


FUZZY_SQL = [
    f"""
bare as (
  select doc_id, {K.sql_words(f"regexp_replace(text, '[^A-Za-z0-9(){lexicon.SPACE_CLASS}]+', '', 'g')")} as w from documents)""",
    """
chunked as (
  select doc_id, 1 as n_words, unnest(w) as chunk from bare
  union all
  select doc_id, 2, unnest(list_transform(range(1, len(w) + 1, 2), lambda i: array_to_string(w[i:i + 1], ' '))) from bare)""",
    f"""
terms as (
  select term, len(string_split(term, ' ')) as n_words from (select unnest({K.sql_list(K.FUZZY_TERMS)}) as term))""",
    """
pairs as (
  select distinct c.n_words, c.chunk, t.term from (select distinct n_words, chunk from chunked) c
  join terms t on c.n_words = t.n_words
  where 200.0 * least(length(c.chunk), length(t.term)) >= 94.5 * (length(c.chunk) + length(t.term)))""",
    f"""
scored as (
  select n_words, chunk, term,
         round_even(200.0 * ({LCS_SQL.format(a='chunk', b='term')}) / (length(chunk) + length(term)), 0) as ratio from pairs)""",
]


@query(
    "hotspot_fuzzy", "V7 F16 F20",
    with_ctes(*FUZZY_SQL) + """
select c.doc_id, s.term, count(*) as value
from chunked c join scored s on c.n_words = s.n_words and c.chunk = s.chunk where s.ratio >= 95 group by 1, 2""",
)
def hotspot_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return V.hotspot_fuzzy(K.documents(spark, sf), "doc_id", "text", K.FUZZY_TERMS)


@query(
    "stay_days", "V8 F14 F15",
    with_views(r"""
dates as (
  select row_id,
    try_cast(nullif(regexp_extract(text, 'Admission Date:\s+\[\*\*(\d+-\d+-\d+)\*\*\]', 1), '') as date) as a,
    try_cast(nullif(regexp_extract(text, 'Discharge Date:\s+\[\*\*(\d+-\d+-\d+)\*\*\]', 1), '') as date) as d
  from noteevents)""") + """
select row_id, case when a <> date '1999-01-01' and d <> date '1999-01-01' then abs(d - a) else 0 end as days from dates""",
)
def stay_days(spark: SparkSession, sf: str) -> DataFrame:
    return note_texts(spark, sf).select("row_id", V.stay_days("text").cast("bigint").alias("days"))


# --- vectors -----------------------------------------------------------------------------------------------

@query(
    "word_vectors", "S9 J9",
    with_ctes(*K.WORD_VECTORS_SQL) + """
select token, round(vec[1], 6) as first, round(vec[64], 6) as last, cast(len(vec) as integer) as width from word_vectors""",
)
def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    combined = W.combine_vectors(*K.word_vectors(spark, sf))
    return combined.select(
        "token",
        F.round(F.col("vec")[0].cast("double"), 6).alias("first"),
        F.round(F.col("vec")[DIM - 1].cast("double"), 6).alias("last"),
        F.size("vec").alias("width"),
    )


TOKENS_SQL = f"""
tokens as (
  select doc_id, unnest(w) as token, generate_subscripts(w, 1) - 1 as pos
  from (select doc_id, {K.sql_words('lower(text)')} as w from documents))"""


# Bytes of texts that are folded at once with a vector per token.
SEQUENCE_BYTES = 1024 * 1024


def lowered(spark: SparkSession, sf: str, size: int = KEYED_BYTES) -> DataFrame:
    return K.keyed_documents(spark, sf, size).withColumn("text", F.lower("text"))


@query(
    "token_vector_lookup", "J9",
    with_ctes(*K.WORD_VECTORS_SQL, TOKENS_SQL) + """
select t.token, count(*) as n, count(v.vec) as n_found, round(any_value(v.vec[1]), 6) as first
from tokens t left join word_vectors v on t.token = v.token group by 1""",
)
def token_vector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    tokens = lowered(spark, sf).select(F.explode(S.words("text")).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    found = W.lookup_vectors(tokens, *K.word_vectors(spark, sf))
    return found.select(
        "token", "n",
        F.when(F.col("vec").isNotNull(), F.col("n")).otherwise(0).alias("n_found"),
        F.round(F.col("vec")[0].cast("double"), 6).alias("first"),
    )


@query(
    "token_vectors", "V10",
    with_ctes(*K.WORD_VECTORS_SQL, TOKENS_SQL) + """
select t.doc_id, cast(t.pos as integer) as pos, t.token, round(coalesce(v.vec[1], 0), 6) as first,
       round(coalesce(list_sum(list_transform(v.vec, lambda x: cast(x as double))), 0), 6) as total
from tokens t left join word_vectors v on t.token = v.token""",
)
def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = W.combine_vectors(*K.word_vectors(spark, sf))
    found = W.token_vectors(lowered(spark, sf), "doc_id", "text", vectors, DIM)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return found.select("doc_id", "pos", "token", r6(F.col("vec")[0].cast("double")).alias("first"), r6(total).alias("total"))


@query(
    "padded_sequences", "V11",
    with_ctes(*K.WORD_VECTORS_SQL, TOKENS_SQL) + f"""
select t.doc_id, cast(count(*) as integer) as n_tokens, {SEQUENCE_LENGTH} as n_rows,
       round(coalesce(sum(cast(v.vec[1] as double)), 0), 6) as sum_first,
       round(coalesce(sum(cast(v.vec[1] as double)) filter (t.pos = {SEQUENCE_LENGTH - 1}), 0), 6) as last_first
from tokens t left join word_vectors v on t.token = v.token where t.pos < {SEQUENCE_LENGTH} group by 1""",
)
def padded_sequences(spark: SparkSession, sf: str) -> DataFrame:
    vectors = W.combine_vectors(*K.word_vectors(spark, sf))
    sequence = W.token_vectors(lowered(spark, sf, SEQUENCE_BYTES), "doc_id", "text", vectors, DIM, SEQUENCE_LENGTH)
    padded = W.pad_sequences(sequence, "doc_id", SEQUENCE_LENGTH, DIM)
    first = F.aggregate("matrix", F.lit(0.0), lambda acc, row: acc + row[0].cast("double"))
    return padded.select(
        "doc_id", "n_tokens", F.size("matrix").alias("n_rows"), r6(first).alias("sum_first"),
        r6(F.col("matrix")[SEQUENCE_LENGTH - 1][0].cast("double")).alias("last_first"),
    )


def average_sql(name: str, divisor: str) -> str:
    return f"""
{name} as (
  select s.doc_id, s.dim, case when s.divisor > 0 then s.total / s.divisor else 0 end as value
  from (
    select d.doc_id, i.dim, coalesce(x.total, 0) as total, {divisor} as divisor
    from documents d cross join (select unnest(range(0, {DIM})) as dim) i
    left join (
      select doc_id, dim, sum(value) as total from (
        select t.doc_id, generate_subscripts(v.vec, 1) - 1 as dim, cast(unnest(v.vec) as double) as value
        from tokens t join word_vectors v on t.token = v.token where t.pos < {CAP}) group by 1, 2) x
      on d.doc_id = x.doc_id and i.dim = x.dim
    left join (select doc_id, count(*) as n from tokens group by 1) n on d.doc_id = n.doc_id) s)"""


PADDED_DIVISOR = f"least({CAP}, (select max(n) from (select count(*) as n from tokens group by doc_id)))"


def _average(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    vectors = W.combine_vectors(*K.word_vectors(spark, sf))
    return W.average_embedding(lowered(spark, sf), "doc_id", "text", vectors, DIM, CAP, mode)


@query(
    "average_embedding", "V12",
    with_ctes(*K.WORD_VECTORS_SQL, TOKENS_SQL, average_sql("averages", PADDED_DIVISOR))
    + "select doc_id, cast(dim as integer) as dim, round(value, 6) + 0.0 as value from averages",
)
def average_embedding(spark: SparkSession, sf: str) -> DataFrame:
    found = _average(spark, sf, "padded")
    return found.select("doc_id", F.posexplode("vec").alias("dim", "value")).withColumn("value", r6("value"))


@query(
    "average_embedding_by_tokens", "V12",
    with_ctes(*K.WORD_VECTORS_SQL, TOKENS_SQL, average_sql("averages", f"least({CAP}, coalesce(n.n, 0))"))
    + "select doc_id, cast(dim as integer) as dim, round(value, 6) + 0.0 as value from averages",
)
def average_embedding_by_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = _average(spark, sf, "tokens")
    return found.select("doc_id", F.posexplode("vec").alias("dim", "value")).withColumn("value", r6("value"))


# --- matrix ------------------------------------------------------------------------------------------------

MATRIX_WIDTH = MATRIX_WORDS + len(K.TERMS) + DIM
HIT_CASES = " ".join(f"when {K.quoted(t)} then {i}" for i, t in enumerate(K.TERMS))
MATRIX_SQL = [
    SPLIT_DOCS_SQL,
    COUNTS_SQL,
    K.vocab_sql("vocab", "counts", MATRIX_WORDS),
    weights_sql("weights", "vocab", "counts", "(select count(*) from documents)", smooth=False, sublinear=True),
    *K.WORD_VECTORS_SQL,
    TOKENS_SQL,
    average_sql("averages", PADDED_DIVISOR),
    f"hits as ({hits_sql(K.TERMS)})",
    f"""
matrix as (
  select doc_id, idx, value from weights
  union all
  select doc_id, {MATRIX_WORDS} + case term {HIT_CASES} end, cast(value as double) from hits where value > 0
  union all
  select doc_id, cast(dim as integer) + {MATRIX_WORDS + len(K.TERMS)}, value from averages)""",
]


def feature_matrix(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    docs = K.keyed_documents(spark, sf)
    counts = word_counts(docs)
    return W.combine_blocks(
        [
            W.word_block(docs, docs, counts, counts, "doc_id", MATRIX_WORDS),
            W.term_block(docs, "doc_id", "text", K.TERMS),
            W.vector_block(_average(spark, sf, "padded"), "doc_id", DIM, "w2v_"),
        ],
        "doc_id",
    )


@query(
    "feature_matrix", "V13 J11",
    with_ctes(*MATRIX_SQL) + "select doc_id, cast(idx as integer) as idx, round(value, 6) + 0.0 as value from matrix",
)
def feature_matrix_triples(spark: SparkSession, sf: str) -> DataFrame:
    return feature_matrix(spark, sf)[0].withColumn("value", r6("value"))


@query(
    "feature_names", "V13 S7",
    with_ctes(*MATRIX_SQL[1:3]) + f"""
select idx, token as feature from vocab
union all
select cast({MATRIX_WORDS} + i - 1 as integer), 'HP_' || ({K.sql_list(K.TERMS)})[i] from (select unnest(range(1, {len(K.TERMS) + 1})) as i)
union all
select cast({MATRIX_WORDS + len(K.TERMS)} + i as integer), 'w2v_' || i from (select unnest(range(0, {DIM})) as i)""",
)
def feature_names(spark: SparkSession, sf: str) -> DataFrame:
    names = feature_matrix(spark, sf)[1]
    return spark.createDataFrame(list(enumerate(names)), "idx int, feature string")


def scaled_sql(fit: str) -> str:
    match = "r.split = p.split and r.idx = p.idx" if fit == "per_split" else "r.split = 'train' and r.idx = p.idx"
    return f"""
, placed as (select m.doc_id, s.split, m.idx, m.value from matrix m join split_docs s on m.doc_id = s.doc_id),
sizes as (select split, count(*) as n from split_docs group by 1),
ranges as (
  select p.split, p.idx,
         case when count(*) < any_value(z.n) then least(min(p.value), 0) else min(p.value) end as lo,
         case when count(*) < any_value(z.n) then greatest(max(p.value), 0) else max(p.value) end as hi
  from placed p join sizes z on p.split = z.split group by 1, 2)
select p.doc_id, p.split, cast(p.idx as integer) as idx,
       round(case when r.lo is null then p.value when r.hi > r.lo then (p.value - r.lo) / (r.hi - r.lo) else 0 end, 6) + 0.0 as value
from placed p left join ranges r on {match}"""


def _scaled(spark: SparkSession, sf: str, fit: str) -> DataFrame:
    triples, names = feature_matrix(spark, sf)
    triples = materialize(D.split_dataset(triples, "doc_id"), "triples")
    docs = D.split_dataset(read_table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "split")
    return W.min_max(triples, docs, "doc_id", fit, len(names)).withColumn("value", r6("value"))


@query("scaled_matrix", "V14", materialized(with_ctes(*MATRIX_SQL) + scaled_sql("per_split")))
def scaled_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf, "per_split")


@query("scaled_matrix_by_train", "V14", materialized(with_ctes(*MATRIX_SQL) + scaled_sql("train")))
def scaled_matrix_by_train(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf, "train")


@query(
    "most_frequent_words", "L7 L5",
    with_ctes(COUNTS_SQL) + """
select token, cast(sum(tf) as bigint) as cf from counts group by 1 order by 2 desc, 1 limit 25""",
)
def most_frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    totals = word_counts(K.keyed_documents(spark, sf)).groupBy("token").agg(F.sum("tf").alias("cf"))
    return R.top_rows(totals, "cf", "token", 25)
