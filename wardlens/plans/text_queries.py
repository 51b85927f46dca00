"""Text queries: scalar functions, cleaning recipes, lemmas, augmentation and encoding, and patient documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions import lexicon
from wardlens.functions import scalars as S
from wardlens.operators import dataset as D
from wardlens.operators import features as V
from wardlens.operators import text as T
from wardlens.plans import cohorts as C
from wardlens.plans import corpus as K
from wardlens.plans.cohort_queries import CLEAN_SQL, COHORT_NOTES_SQL, PREFIX
from wardlens.plans.registry import query, with_ctes, with_views
from wardlens.sources.tables import load_tables

STOP = lexicon.ENGLISH_STOP_WORDS


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return load_tables(spark, sf).notes.select("row_id", "text")


# --- scalar functions --------------------------------------------------------------------------------------

@query(
    "redactions_removed", "F2 F1 F3",
    with_views() + r"""
select row_id, regexp_replace(text, '\[\*\*(.*)\*\*\]', '', 'g') as greedy,
       regexp_replace(text, '\[\*\*([^\n]*?)\*\*\]', '', 'g') as mark_by_mark,
       replace(lower(text), ',', '') as no_commas
from noteevents""",
)
def redactions_removed(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select(
        "row_id",
        S.strip_redactions("text").alias("greedy"),
        S.strip_redactions("text", greedy=False).alias("mark_by_mark"),
        S.strip_commas(F.lower("text")).alias("no_commas"),
    )


@query(
    "word_split", "F10 F11 F12 T5 T6",
    f"""
select doc_id, len({K.sql_words('text')}) as n_words, {K.sql_join(K.sql_at_least(K.sql_words('text'), 3))} as long_words,
       {K.sql_join(K.sql_without(K.sql_words('text'), STOP))} as without_stop_words,
       {K.sql_join(K.sql_without(K.sql_words('lower(text)'), ['the', 'of']))} as without_fixed_words,
       {K.sql_replace('text', '[^a-zA-Z]', ' ')} as letters_only
from documents""",
)
def word_split(spark: SparkSession, sf: str) -> DataFrame:
    return K.documents(spark, sf).select(
        "doc_id",
        F.size(S.words("text")).cast("bigint").alias("n_words"),
        S.join_words(S.min_length(S.words("text"), 3)).alias("long_words"),
        S.join_words(S.remove_words(S.words("text"), STOP)).alias("without_stop_words"),
        S.join_words(S.remove_words(S.words(F.lower("text")), ["the", "of"])).alias("without_fixed_words"),
        F.regexp_replace("text", "[^a-zA-Z]", " ").alias("letters_only"),
    )


@query(
    "pattern_matches", "F13 F19",
    f"""
select doc_id, len(regexp_extract_all(text, 'th[ae]')) as n_matches,
       text like '%tion%' or text like '%ble%' or text like '%was%' as has_keyword
from documents""",
)
def pattern_matches(spark: SparkSession, sf: str) -> DataFrame:
    return K.documents(spark, sf).select(
        "doc_id",
        S.count_matches("text", "th[ae]").cast("bigint").alias("n_matches"),
        S.contains_any("text", K.KEYWORDS).alias("has_keyword"),
    )


DATES_SQL = r"""
dates as (
  select row_id,
    try_cast(nullif(regexp_extract(text, 'Admission Date:\s+\[\*\*(\d+-\d+-\d+)\*\*\]', 1), '') as date) as admitted,
    try_cast(nullif(regexp_extract(text, 'Discharge Date:\s+\[\*\*(\d+-\d+-\d+)\*\*\]', 1), '') as date) as discharged
  from noteevents)"""


@query(
    "dates_in_notes", "F14 F15",
    with_views(DATES_SQL) + """
select row_id, cast(admitted as varchar) as admitted, cast(discharged as varchar) as discharged,
       abs(discharged - admitted) as days from dates""",
)
def dates_in_notes(spark: SparkSession, sf: str) -> DataFrame:
    admitted, discharged = S.date_after("text", "Admission Date:"), S.date_after("text", "Discharge Date:")
    return notes(spark, sf).select(
        "row_id",
        admitted.cast("string").alias("admitted"),
        discharged.cast("string").alias("discharged"),
        S.absolute_days(discharged, admitted).cast("bigint").alias("days"),
    )


LCS_SQL = """
list_reduce(range(1, length({a}) + 1),
  lambda prev, i: list_reduce(range(1, length({b}) + 1),
    lambda acc, j: list_append(acc, case when substr({a}, i, 1) = substr({b}, j, 1) then prev[j] + 1
                                         else greatest(prev[j + 1], acc[len(acc)]) end), [0]),
  list_transform(range(0, length({b}) + 1), lambda z: 0))[length({b}) + 1]"""


@query(
    "brand_similarity", "F16",
    f"""
with pairs as (
  select distinct p_type as a, s_name as b from part join supplier on p_size = s_nationkey),
scored as (
  select a, b, {LCS_SQL.format(a='a', b='b')} as common from pairs)
select a, b, cast(common as integer) as common,
       cast(round_even(200.0 * common / (length(a) + length(b)), 0) as integer) as ratio
from scored""",
)
def brand_similarity(spark: SparkSession, sf: str) -> DataFrame:
    from wardlens.sources.tables import read_table

    # repeats go before the join: it then makes a pair once per nation at most, not once per part and supplier
    part = read_table(spark, sf, "part").select(F.col("p_type").alias("a"), F.col("p_size").alias("nation")).distinct()
    supplier = read_table(spark, sf, "supplier").select(F.col("s_name").alias("b"), F.col("s_nationkey").alias("nation")).distinct()
    pairs = part.join(supplier, "nation").select("a", "b").distinct()
    # pairs are few bytes and much work: dealt to all cores, whatever their size
    cores = spark.sparkContext.defaultParallelism
    common = S.common_subsequence_lengths("a", "b").alias("common")
    return pairs.repartition(4 * cores, "a", "b").select("a", "b", common).select(
        "a", "b", "common", S.ratio_of(F.col("common"), "a", "b").alias("ratio")
    )


ACCENTS = lexicon.accent_table()


@query(
    "accents_removed", "F17",
    f"""
select doc_id, translate(text, {K.quoted(ACCENTS[0] + ACCENTS[2])}, {K.quoted(ACCENTS[1])}) as text from documents""",
)
def accents_removed(spark: SparkSession, sf: str) -> DataFrame:
    return K.documents(spark, sf).select("doc_id", S.strip_accents("text").alias("text"))


@query(
    "alphabetic_tokens", "F18 F20",
    f"""
select doc_id, len(list_filter(w, lambda t: regexp_matches(t, '^\\pL+$'))) as n_alphabetic,
       array_to_string(list_transform(range(1, len(w) + 1, 3), lambda i: array_to_string(w[i:i + 2], ' ')), '|') as triples
from (select doc_id, {K.sql_words('text')} as w from documents)""",
)
def alphabetic_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = S.words("text")
    return K.documents(spark, sf).select(
        "doc_id",
        F.size(F.filter(tokens, S.is_alphabetic)).cast("bigint").alias("n_alphabetic"),
        F.array_join(S.chunks(tokens, 3), "|").alias("triples"),
    )


# --- cleaning recipes --------------------------------------------------------------------------------------

@query(
    "clean_notes", "T1",
    with_views() + f"select row_id, {CLEAN_SQL.format('text')} as clean_text from noteevents",
)
def clean_notes(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("row_id", C.clean_note().alias("clean_text"))


def clean_tokens_sql(text: str) -> str:
    letters = K.sql_replace(text, "[^a-zA-Z]", " ")
    return K.sql_join(K.sql_lemmas(K.sql_without(K.sql_words(f"lower({letters})"), STOP), K.LEMMAS))


@query("clean_tokens", "T2 T5 T8", f"select doc_id, {clean_tokens_sql('text')} as text from documents")
def clean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return K.documents(spark, sf).select("doc_id", T.clean_tokens(F.col("text"), lemmas=K.LEMMAS).alias("text"))


def clean_for_embedding_sql(text: str) -> str:
    bare = f"lower(translate({K.sql_delete(text, lexicon.PUNCTUATION)}, chr(10), ' '))"
    kept = K.sql_join(K.sql_at_least(K.sql_without(K.sql_words(bare), STOP), 3))
    timeless = K.sql_replace(kept, "[0-9]{4}pm", "")
    words = K.sql_lemmas(K.sql_without(K.sql_words(timeless), lexicon.NON_ESSENTIAL_WORDS), K.LEMMAS)
    return K.sql_replace(K.sql_join(words), "[^a-zA-Z]", " ")


@query(
    "clean_for_embedding", "T3 T6 F10 F12",
    with_views() + f"select row_id, {clean_for_embedding_sql('text')} as text from noteevents",
)
def clean_for_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("row_id", T.clean_for_embedding(F.col("text"), lemmas=K.LEMMAS).alias("text"))


def clean_clinical_sql(text: str) -> str:
    plain = K.sql_substitute(f"lower({text})", lexicon.CLINICAL_SUBSTITUTIONS)
    kept = K.sql_join(K.sql_lemmas(K.sql_at_least(K.sql_words(plain), 3), K.LEMMAS))
    bare = K.sql_delete(K.sql_replace(kept, "[0-9]", " "), lexicon.PUNCTUATION_KEEP_STOP)
    return f"translate({bare}, chr(10), ' ')"


@query("clean_clinical", "T4 T7", with_views() + f"select row_id, {clean_clinical_sql('text')} as text from noteevents")
def clean_clinical(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("row_id", T.clean_clinical(F.col("text"), lemmas=K.LEMMAS).alias("text"))


@query(
    "substituted_phrases", "T7",
    with_views() + f"select row_id, {K.sql_substitute('lower(text)', lexicon.CLINICAL_SUBSTITUTIONS)} as text from noteevents",
)
def substituted_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select(
        "row_id", S.substitute(F.lower("text"), lexicon.CLINICAL_SUBSTITUTIONS).alias("text")
    )


@query(
    "document_word_counts", "T10",
    f"select doc_id, len(regexp_extract_all(text, {K.quoted(lexicon.TOKEN)})) as word_count from documents",
)
def document_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return K.documents(spark, sf).select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("word_count"))


@query(
    "document_sentences", "T11",
    f"""
select doc_id, len(s) as n_sentences, array_to_string(s, '|') as sentences
from (select doc_id, {K.sql_sentences('text')} as s from documents)""",
)
def document_sentences(spark: SparkSession, sf: str) -> DataFrame:
    found = S.sentences("text")
    return K.documents(spark, sf).select(
        "doc_id", F.size(found).cast("bigint").alias("n_sentences"), F.array_join(found, "|").alias("sentences")
    )


# --- lemmas ------------------------------------------------------------------------------------------------

LOWER_WORDS_SQL = "regexp_extract_all(lower(text), '[a-z]+')"
VOCABULARY_SQL = f"vocabulary as (select distinct unnest({LOWER_WORDS_SQL}) as token from documents)"


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return K.documents(spark, sf).select(F.explode(F.array_distinct(tokens)).alias("token")).distinct()


def _suffix_sql() -> str:
    rules = "\n  union all\n  ".join(
        f"select token, {i + 1} as turn, substr(token, 1, length(token) - {len(a)}) || '{b}' as lemma "
        f"from vocabulary where token like '%{a}'"
        for i, (a, b) in enumerate(lexicon.NOUN_SUFFIXES)
    )
    return f"""
tried as (
  select token, 0 as turn, token as lemma from vocabulary
  union all
  {rules}),
suffix_lemmas as (
  select token, lemma from (
    select t.token, t.lemma, row_number() over (partition by t.token order by length(t.lemma), t.turn) as rn
    from tried t join vocabulary v on t.lemma = v.token where length(t.lemma) > 0)
  where rn = 1 and lemma <> token)"""


@query("suffix_lemmas", "T8", with_ctes(VOCABULARY_SQL, _suffix_sql()) + "select token, lemma from suffix_lemmas")
def suffix_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    return T.suffix_lemmas(vocabulary(spark, sf))


@query(
    "lemmatized_documents", "T8",
    with_ctes(
        VOCABULARY_SQL, _suffix_sql(),
        f"""
tokens as (
  select doc_id, unnest(w) as token, generate_subscripts(w, 1) as pos
  from (select doc_id, {K.sql_words('lower(text)')} as w from documents))""",
    ) + """
select d.doc_id, coalesce(x.text, '') as text
from documents d left join (
  select t.doc_id, string_agg(coalesce(l.lemma, t.token), ' ' order by t.pos) as text
  from tokens t left join suffix_lemmas l on t.token = l.token group by 1) x on d.doc_id = x.doc_id""",
)
def lemmatized_documents(spark: SparkSession, sf: str) -> DataFrame:
    lowered = K.keyed_documents(spark, sf).withColumn("text", F.lower("text"))
    return T.lemmatize(lowered, "doc_id", "text", T.suffix_lemmas(vocabulary(spark, sf)))


@query(
    "dominant_pos", "T9",
    f"""
with senses as (
  select token as word, substr('nvars', cast(doc_id % 5 as integer) + 1, 1) as pos
  from (select doc_id, unnest({LOWER_WORDS_SQL}) as token from documents)),
counted as (
  select word, count(*) filter (pos = 'n') as n, count(*) filter (pos = 'v') as v,
         count(*) filter (pos = 'a') as a, count(*) filter (pos = 'r') as r from senses group by 1)
select word, case when n >= greatest(v, a, r) then 'n' when v >= greatest(a, r) then 'v' when a >= r then 'a' else 'r' end as pos,
       greatest(n, v, a, r) as n_senses
from counted""",
)
def dominant_pos(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    senses = K.documents(spark, sf).select(
        F.explode(tokens).alias("word"), F.substring(F.lit("nvars"), (F.col("doc_id") % 5).cast("int") + 1, 1).alias("pos")
    )
    return T.dominant_pos(senses)


# --- vocabularies over texts -------------------------------------------------------------------------------

BAND_SQL = f"""
band as (
  select token, df from (
    select token, count(*) as df from (
      select distinct doc_id, unnest({K.sql_tokens('text', lexicon.WORD_2, accents=False)}) as token from documents) group by 1)
  where df >= 0.1 * (select count(*) from documents) and df <= 0.7 * (select count(*) from documents))"""


def band_vocabulary(docs: DataFrame) -> DataFrame:
    frequencies = V.document_frequency(docs, "doc_id", S.vector_tokens("text", lexicon.WORD_2, accents=False))
    return V.df_band_vocab(frequencies, V.document_count(docs, "doc_id"))


@query("document_frequency_band", "V3", with_ctes(BAND_SQL) + "select token, df from band")
def document_frequency_band(spark: SparkSession, sf: str) -> DataFrame:
    return band_vocabulary(K.documents(spark, sf))


@query(
    "texts_in_vocabulary", "T12",
    with_ctes(
        BAND_SQL,
        f"""
tokens as (
  select doc_id, unnest(w) as token, generate_subscripts(w, 1) as pos
  from (select doc_id, regexp_extract_all(text, {K.quoted(lexicon.TOKEN)}) as w from documents))""",
    ) + """
select d.doc_id, coalesce(x.text, '') as text
from documents d left join (
  select t.doc_id, string_agg(t.token, ' ' order by t.pos) as text
  from tokens t join band b on t.token = b.token group by 1) x on d.doc_id = x.doc_id""",
)
def texts_in_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    docs = K.keyed_documents(spark, sf)
    return T.restrict_to_vocab(docs, "doc_id", "text", band_vocabulary(docs))


@query(
    "extension_tokens", "T15 F18 V2 A18",
    f"""
with frequencies as (
  select token, count(*) as df from (
    select distinct doc_id, unnest({K.sql_tokens('text', lexicon.WORD_2, lowercase=False, accents=False)}) as token from documents)
  group by 1),
weighted as (
  select token, df, ln((1 + (select count(*) from documents)) / (1 + df)) + 1 as idf from frequencies)
select token, df, round(idf, 6) as idf from weighted
where idf <= (select quantile_cont(idf, 0.7) from weighted) and regexp_matches(token, '^\\pL+$')""",
)
def extension_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return V.extension_tokens(K.documents(spark, sf), "doc_id", "text").withColumn("idf", F.round("idf", 6))


# --- augmentation and encoding -----------------------------------------------------------------------------

@query(
    "augmented_documents", "T13 U3 T11 F19",
    f"""
with parts as (
  select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as i
  from (select doc_id, {K.sql_sentences('text')} as s from documents)),
copies as (select doc_id, unnest(range(1, 11)) as copy from documents),
shuffled as (
  select c.doc_id, c.copy, p.sentence,
         row_number() over (partition by c.doc_id, c.copy order by
           case when {' or '.join(f"contains(p.sentence, '{k}')" for k in K.KEYWORDS)} then 0 else 1 end,
           md5(concat('42|', c.doc_id, '|', c.copy, '|', p.i)), p.i) as rn
  from copies c join parts p on c.doc_id = p.doc_id)
select doc_id, cast(copy as integer) as copy, md5(text) as digest, length(text) as n_chars from (
  select doc_id, 0 as copy, text from documents
  union all
  select c.doc_id, c.copy, coalesce(x.text, '') from copies c left join (
    select doc_id, copy, string_agg(sentence, ' ' order by rn) as text from shuffled group by 1, 2) x
    on c.doc_id = x.doc_id and c.copy = x.copy)""",
)
def augmented_documents(spark: SparkSession, sf: str) -> DataFrame:
    grown = T.augment_shuffle(K.documents(spark, sf), "doc_id", keywords=K.KEYWORDS)
    return grown.select("doc_id", "copy", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


ENCODE_WORDS, ENCODE_LENGTH = 2000, 512


@query(
    "encoded_documents", "T14",
    with_ctes(
        K.counts_sql("counts", tokens=f"regexp_extract_all(lower(text), {K.quoted(lexicon.TOKEN)})", stop_words=()),
        K.vocab_sql("vocab", "counts", ENCODE_WORDS),
        f"""
tokens as (
  select doc_id, unnest(w) as token, generate_subscripts(w, 1) as pos
  from (select doc_id, regexp_extract_all(lower(text), {K.quoted(lexicon.TOKEN)})[1:{ENCODE_LENGTH - 2}] as w from documents))""",
        """
ids as (
  select t.doc_id, list(coalesce(v.idx + 4, 1) order by t.pos) as ids
  from tokens t left join vocab v on t.token = v.token group by 1)""",
        """
bodies as (
  select d.doc_id, list_concat(list_concat([2], coalesce(i.ids, [])), [3]) as body
  from documents d left join ids i on d.doc_id = i.doc_id)""",
    ) + f"""
select doc_id,
       array_to_string(list_concat(body, list_transform(range({ENCODE_LENGTH} - len(body)), lambda z: 0)), ' ') as input_ids,
       array_to_string(list_concat(list_transform(body, lambda z: 1),
                                   list_transform(range({ENCODE_LENGTH} - len(body)), lambda z: 0)), ' ') as attention_mask
from bodies""",
)
def encoded_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = K.keyed_documents(spark, sf)
    counts = V.token_counts(docs, "doc_id", S.word_tokens(F.lower("text")), ())
    encoded = T.encode_sequences(docs, "doc_id", "text", V.top_vocab(counts, ENCODE_WORDS), ENCODE_LENGTH)
    return encoded.select(
        "doc_id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("attention_mask", " ").alias("attention_mask")
    )


# --- patient documents -------------------------------------------------------------------------------------

def cohort(spark: SparkSession, sf: str) -> DataFrame:
    return C.cohort_notes(load_tables(spark, sf), PREFIX)


PATIENT_SQL = """
patient_documents as (
  select subject_id, min(hadm_id) as first_hadm_id, count(*) as n_notes,
         string_agg(clean_text, '' order by hadm_id, row_id) as text, max(label) as label
  from cohort_notes group by 1)"""


@query(
    "patient_documents", "D1 A13 A14 U2",
    with_views(*COHORT_NOTES_SQL, PATIENT_SQL) + "select * from patient_documents",
)
def patient_documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.patient_documents(cohort(spark, sf))


@query(
    "patient_documents_for_embedding", "D2 T3 A15 J8 L4",
    with_views(*COHORT_NOTES_SQL) + f"""
select t.subject_id, t.first_hadm_id, t.n_notes, t.text, l.label
from (select subject_id, min(hadm_id) as first_hadm_id, count(*) as n_notes,
             string_agg({clean_for_embedding_sql('clean_text')}, ',' order by hadm_id, row_id) as text
      from cohort_notes group by 1) t
join (select distinct subject_id, label from cohort_notes) l on t.subject_id = l.subject_id""",
)
def patient_documents_for_embedding(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = cohort(spark, sf).withColumn("clean_text", T.clean_for_embedding(F.col("clean_text"), lemmas=K.LEMMAS))
    return D.patient_documents(cleaned, sep=",", label_mode="distinct")


@query(
    "max_label_per_subject", "A13",
    with_views(*COHORT_NOTES_SQL) + "select subject_id, max(label) as label from cohort_notes group by 1",
)
def max_label_per_subject(spark: SparkSession, sf: str) -> DataFrame:
    return D.max_label(cohort(spark, sf))


@query(
    "note_texts_per_admission", "A14 A15",
    with_views() + """
select hadm_id, min(row_id) as first_row_id, count(*) as n_notes, string_agg(text, ',' order by row_id) as text
from noteevents where hadm_id is not null group by 1""",
)
def note_texts_per_admission(spark: SparkSession, sf: str) -> DataFrame:
    return D.patient_documents(
        load_tables(spark, sf).notes, sep=",", label_mode=None, key="hadm_id", order=("row_id",), text="text"
    )


@query(
    "longest_text", "A16",
    f"select max(len({K.sql_words('text')})) as max_tokens from documents",
)
def longest_text(spark: SparkSession, sf: str) -> DataFrame:
    return D.max_tokens(K.documents(spark, sf)).select(F.col("max_tokens").cast("bigint").alias("max_tokens"))


BUCKET_SQL = "cast(('0x' || substr(md5(concat('42|', {0})), 1, 8)) as bigint) % 1000"
SPLIT_SQL = f"""case when {BUCKET_SQL} < 600 then 'train' when {BUCKET_SQL} < 800 then 'val' else 'test' end"""


@query("split_documents", "D3", f"select doc_id, {SPLIT_SQL.format('doc_id')} as split from documents")
def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.split_dataset(K.documents(spark, sf), "doc_id").select("doc_id", "split")


@query(
    "split_patients", "D3 D1",
    with_views(*COHORT_NOTES_SQL, PATIENT_SQL) + f"""
select subject_id, label, {SPLIT_SQL.format('subject_id')} as split from patient_documents""",
)
def split_patients(spark: SparkSession, sf: str) -> DataFrame:
    found = D.patient_documents(cohort(spark, sf))
    return D.split_dataset(found, "subject_id").select("subject_id", "label", "split")


@query(
    "split_sizes", "A17",
    f"select {SPLIT_SQL.format('doc_id')} as split, count(*) as n_rows from documents group by 1",
)
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return D.split_sizes(D.split_dataset(K.documents(spark, sf), "doc_id"))


@query(
    "fit_rows", "D4 U2",
    f"""
select doc_id, split from (select doc_id, {SPLIT_SQL.format('doc_id')} as split from documents) where split in ('train', 'val')""",
)
def fit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return D.fit_rows(D.split_dataset(K.documents(spark, sf), "doc_id")).select("doc_id", "split")
