from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlens.functions import lexicon
from wardlens.functions import scalars as S
from wardlens.operators import text as T


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "text string").select(build(F.col("text")).alias("x")).first()["x"]


def test_greedy_redaction_goes_from_first_to_last_mark_of_a_line(spark):
    text = "a [**x**] b [**y**] c\nd [**z**] e\rf [**w**]"
    assert one(spark, text, S.strip_redactions) == "a  c\nd "
    assert one(spark, text, lambda c: S.strip_redactions(c, greedy=False)) == "a  b  c\nd  e\rf "


def test_words_split_on_unicode_spaces(spark):
    text = " a b c\x1cd\n\te "
    assert one(spark, text, S.words) == text.split()


def test_contractions_survive_the_embedding_clean(spark):
    text = "The patient don't take, 1234pm admission IT IS also x1y2z"
    assert one(spark, text, T.clean_for_embedding) == "patient dont take x y z"


def test_token_clean_drops_stop_words_and_maps_lemmas(spark):
    assert one(spark, "The cats and 2 dogs", lambda c: T.clean_tokens(c, lemmas={"cats": "cat"})) == "cat dogs"


def test_clinical_clean_order(spark):
    text = "Admission Date: [**2101-1-1**] Major Surgical or Invasive Procedure: none. café ab 12x Discharge Medications: aspirin -- also"
    assert one(spark, text, T.clean_clinical) == "procedure none. caf   x medications aspirin"


def test_sentences_keep_their_marks(spark):
    assert one(spark, "One. Two!? three\n", S.sentences) == ["One.", "Two!?", "three"]
    assert one(spark, "", S.sentences) == []


def test_accents(spark):
    assert one(spark, "Été ñ ß é", S.strip_accents) == "Ete n ß e"


def test_chunks(spark):
    assert one(spark, "a b c d e", lambda c: S.chunks(S.words(c), 2)) == ["a b", "c d", "e"]
    assert one(spark, "", lambda c: S.chunks(S.words(c), 2)) == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("pairs", [[("kitten", "sitting"), ("", "abc"), ("", ""), ("abcd", "abcd"), ("ab", "ba")]])
def test_similarity_of_known_pairs(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.fuzzy_ratio("a", "b").alias("r"))
    for row in rows.collect():
        total = len(row.a) + len(row.b)
        assert row.r == (round(200 * lcs(row.a, row.b) / total) if total else 100)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=8), st.text("abc", max_size=8)), min_size=1, max_size=30))
def test_common_subsequence(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.common_subsequence_length("a", "b").alias("n"))
    assert all(row.n == lcs(row.a, row.b) for row in rows.collect())


def test_augmentation_permutes_sentences_and_puts_keywords_first(spark):
    text = "Alpha one. heart two. Gamma three. pain four. Delta five."
    df = spark.createDataFrame([(1, text, 1), (2, "", 0)], "doc_id long, text string, label int")
    rows = T.augment_shuffle(df, "doc_id", copies=10).collect()
    assert len(rows) == 22
    texts = {r["text"] for r in rows if r["doc_id"] == 1 and r["copy"] > 0}
    assert len(texts) > 3
    for shuffled in texts:
        parts = [s.strip() + "." for s in shuffled.split(".") if s.strip()]
        assert Counter(parts) == Counter(s.strip() + "." for s in text.split(".") if s.strip())
        assert {"heart two.", "pain four."} == set(parts[:2])
    again = T.augment_shuffle(df.repartition(3), "doc_id", copies=10).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_lemma_table_gives_the_same_small_and_large(spark):
    df = spark.createDataFrame([(1, "cats run cats"), (2, "")], "doc_id long, text string")
    lemmas = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    small = {r["doc_id"]: r["text"] for r in T.lemmatize(df, "doc_id", "text", lemmas).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = {r["doc_id"]: r["text"] for r in T.lemmatize(df, "doc_id", "text", lemmas).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert small == large == {1: "cat run cat", 2: ""}


def test_suffix_lemmas_need_the_vocabulary(spark):
    vocab = spark.createDataFrame([(w,) for w in ["cat", "box", "bus", "woman", "glas", "pass"]], "token string")
    tokens = spark.createDataFrame([(w,) for w in ["cats", "boxes", "bus", "women", "dogs", "pass"]], "token string")
    found = {r["token"]: r["lemma"] for r in T.suffix_lemmas(tokens, vocab).collect()}
    assert found == {"cats": "cat", "boxes": "box", "women": "woman"}
    own = spark.createDataFrame([("women",), ("woman",)], "token string")
    assert T.suffix_lemmas(own).collect() == []


def test_dominant_pos_ties_and_unknown(spark):
    senses = spark.createDataFrame([("a", "v"), ("a", "n"), ("b", "r"), ("b", "r"), ("b", "n"), ("c", "s")], "word string, pos string")
    assert {r["word"]: r["pos"] for r in T.dominant_pos(senses).collect()} == {"a": "n", "b": "r", "c": "n"}


def test_encoding_truncates_pads_and_masks(spark):
    df = spark.createDataFrame([(1, "a b zz a"), (2, ""), (3, "a a a a a a a a")], "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, idx int")
    rows = {r["doc_id"]: r for r in T.encode_sequences(df, "doc_id", "text", vocab, 7).collect()}
    assert rows[1]["input_ids"] == [2, 4, 5, 1, 4, 3, 0] and rows[1]["attention_mask"] == [1] * 6 + [0]
    assert rows[2]["input_ids"] == [2, 3] + [0] * 5
    assert rows[3]["input_ids"] == [2] + [4] * 5 + [3]


def test_stop_list_size():
    assert len(lexicon.ENGLISH_STOP_WORDS) == len(set(lexicon.ENGLISH_STOP_WORDS)) == 179
