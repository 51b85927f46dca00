"""Cleaning recipes and corpus transforms. Cleaning is Column in, Column out; nothing shuffles a text for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions import lexicon
from wardlens.functions import scalars as S
from wardlens.operators.relations import join_grouped
from wardlens.session import sent

# --- cleaning recipes --------------------------------------------------------------------------------------


def clean_tokens(
    text: Column, stop_words: Sequence[str] = lexicon.ENGLISH_STOP_WORDS, lemmas: dict[str, str] | None = None
) -> Column:
    """Letters only, lower case, stop words off, lemma per token."""
    tokens = S.words(F.lower(F.regexp_replace(text, "[^a-zA-Z]", " ")))
    return S.join_words(S.lemma_map(S.remove_words(tokens, stop_words), lemmas or {}))


def clean_for_embedding(
    text: Column, stop_words: Sequence[str] = lexicon.ENGLISH_STOP_WORDS, lemmas: dict[str, str] | None = None
) -> Column:
    """The clean that goes before word vectors.

    Punctuation is deleted before the stop list is applied, so contractions lose their apostrophe and stay.
    """
    bare = F.lower(F.translate(S.delete_characters(text, lexicon.PUNCTUATION), "\n", " "))
    tokens = S.min_length(S.remove_words(S.words(bare), stop_words), 3)
    timeless = F.regexp_replace(S.join_words(tokens), "[0-9]{4}pm", "")
    kept = S.lemma_map(S.remove_words(S.words(timeless), lexicon.NON_ESSENTIAL_WORDS), lemmas or {})
    return F.regexp_replace(S.join_words(kept), "[^a-zA-Z]", " ")


def clean_clinical(text: Column, lemmas: dict[str, str] | None = None) -> Column:
    """Lower case, clinical headers and phrases off, short words off, digits and punctuation off but the full stop."""
    plain = S.substitute(F.lower(text), lexicon.CLINICAL_SUBSTITUTIONS)
    kept = S.join_words(S.lemma_map(S.min_length(S.words(plain), 3), lemmas or {}))
    return F.translate(
        S.delete_characters(F.regexp_replace(kept, "[0-9]", " "), lexicon.PUNCTUATION_KEEP_STOP), "\n", " "
    )


def word_count(text: Column) -> Column:
    """Words and punctuation marks of a text."""
    return F.size(S.word_tokens(text))


# --- lemmas ------------------------------------------------------------------------------------------------

def suffix_lemmas(tokens: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(token, lemma) for tokens that a noun ending turns into another word of the vocabulary.

    The shortest of the token itself, if it is in the vocabulary, and the words its endings lead to wins; on a
    tie the token itself, then the earlier ending. Tokens that are their own lemma are left out.
    """
    vocabulary = tokens if vocabulary is None else vocabulary
    token = F.col("token")
    candidates = [F.struct(F.lit(0).alias("turn"), token.alias("lemma"))] + [
        F.when(
            token.endswith(ending),
            F.struct(
                F.lit(i + 1).alias("turn"),
                F.concat(token.substr(F.lit(1), F.length(token) - len(ending)), F.lit(becomes)).alias("lemma"),
            ),
        )
        for i, (ending, becomes) in enumerate(lexicon.NOUN_SUFFIXES)
    ]
    tried = tokens.select(token, F.inline(F.array_compact(F.array(*candidates)))).filter(F.length("lemma") > 0)
    known = tried.join(vocabulary.select(token.alias("lemma")), "lemma", "left_semi")
    best = F.min(F.struct(F.length("lemma").alias("n"), "turn", "lemma")).alias("best")
    found = known.groupBy("token").agg(best).select("token", F.col("best.lemma").alias("lemma"))
    return found.filter(F.col("lemma") != F.col("token"))


def dominant_pos(senses: DataFrame) -> DataFrame:
    """Most frequent part of speech of each word; ties go to noun, verb, adjective, adverb in that order.

    Senses of other kinds are not counted, and a word with none of the four is a noun.
    """
    counted = senses.groupBy("word").agg(*[F.count_if(F.col("pos") == p).alias(p) for p in lexicon.POS_ORDER])
    most = F.greatest(*lexicon.POS_ORDER)
    choice = F.coalesce(*[F.when(F.col(p) == most, p) for p in lexicon.POS_ORDER])
    return counted.select("word", choice.alias("pos"), most.alias("n_senses"))


# --- token tables ------------------------------------------------------------------------------------------

def token_positions(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """One row per token: (key, pos, token); a text without tokens keeps one row with NULLs."""
    return df.select(key, F.posexplode_outer(tokens).alias("pos", "token"))


def lookup_tokens(positions: DataFrame, key: str, table: DataFrame, how: str = "left", most: int | None = None) -> DataFrame:
    """Join (key, pos, token) rows with a table keyed by token.

    The table is written once. Up to MOST_SENT rows join in place, whatever the optimizer expects of its size. A
    larger one shuffles by token, where a frequent word would be one huge group: so repeats within a text are folded
    into one row with their positions first, which leaves at most one row per text and word.
    """
    table, small = sent(table, "lookup", most)
    if small:
        return positions.join(table, "token", how)
    folded = positions.groupBy(key, "token").agg(F.collect_list("pos").alias("places"))
    joined = join_grouped(folded, table, ["token"], how)
    columns = [c for c in joined.columns if c not in ("places",)]
    return joined.select(*columns, F.explode_outer("places").alias("pos"))


def rebuild_text(positions: DataFrame, key: str, column: str, name: str = "text") -> DataFrame:
    """Texts from (key, pos, column) rows, in the order of ``pos``; NULLs are left out."""
    entries = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("pos", column))))
    return positions.groupBy(key).agg(F.array_join(F.transform(entries, lambda e: e[column]), " ").alias(name))


def lemmatize(df: DataFrame, key: str, text: str, lemmas: DataFrame) -> DataFrame:
    """Replace every token that has a lemma in the table (token, lemma)."""
    positions = token_positions(df, key, S.words(text))
    found = lookup_tokens(positions, key, lemmas).withColumn("word", F.coalesce("lemma", "token"))
    return rebuild_text(found, key, "word", text)


def restrict_to_vocab(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """Keep only the tokens in the vocabulary; order and repeats stay."""
    positions = token_positions(df, key, S.word_tokens(text))
    known = vocabulary.select("token", F.col("token").alias("word"))
    return rebuild_text(lookup_tokens(positions, key, known), key, "word", text)


# --- augmentation and encoding -----------------------------------------------------------------------------

def augment_shuffle(
    df: DataFrame,
    key: str,
    text: str = "text",
    keywords: Sequence[str] = lexicon.SENTENCE_KEYWORDS,
    copies: int = 10,
    seed: int = 42,
) -> DataFrame:
    """The rows plus ``copies`` versions of each with its sentences permuted, those with a keyword first.

    The permutation is the order of a hash of seed, key, copy and position: the same under any partitioning,
    and made within the row, so nothing is shuffled. Column ``copy`` is 0 for the original.
    """
    others = [c for c in df.columns if c != text]
    numbered = F.transform(
        S.sentences(text),
        lambda s, i: F.named_struct(F.lit("i"), i, F.lit("front"), S.contains_any(s, keywords), F.lit("s"), s),
    )
    spread = df.select(*others, numbered.alias("parts"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    salt = F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"), F.lit("|"), F.col("copy").cast("string"), F.lit("|"))
    ordered = F.array_sort(
        F.transform(
            "parts",
            lambda p: F.named_struct(
                F.lit("back"), ~p["front"],
                F.lit("h"), F.md5(F.concat(salt, p["i"].cast("string"))),
                F.lit("i"), p["i"],
                F.lit("s"), p["s"],
            ),
        )
    )
    shuffled = spread.select(*others, "copy", F.array_join(F.transform(ordered, lambda p: p["s"]), " ").alias(text))
    return append_augmented(df.withColumn("copy", F.lit(0)), shuffled)


def append_augmented(df: DataFrame, augmented: DataFrame) -> DataFrame:
    return df.unionByName(augmented)


# ids of the special tokens; words follow from FIRST_WORD_ID
PAD_ID, UNKNOWN_ID, START_ID, END_ID, FIRST_WORD_ID = 0, 1, 2, 3, 4


def encode_sequences(df: DataFrame, key: str, text: str, vocabulary: DataFrame, max_len: int = 512) -> DataFrame:
    """Fixed-length ids and attention mask: start, up to ``max_len - 2`` words, end, padding.

    ``vocabulary`` has (token, idx). Words past the length are cut before they are looked up.
    """
    tokens = F.slice(S.word_tokens(F.lower(F.col(text))), 1, max_len - 2)
    found = lookup_tokens(token_positions(df, key, tokens), key, vocabulary.select("token", "idx"))
    entry = F.struct("pos", F.coalesce(F.col("idx") + FIRST_WORD_ID, F.lit(UNKNOWN_ID)).cast("int").alias("id"))
    ids = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), entry))), lambda e: e["id"]
    )
    body = F.concat(F.array(F.lit(START_ID)), "ids", F.array(F.lit(END_ID)))
    rest = F.lit(max_len) - F.size("body")
    return (
        found.groupBy(key)
        .agg(ids.alias("ids"))
        .select(key, body.alias("body"))
        .select(
            key,
            F.concat("body", F.array_repeat(F.lit(PAD_ID), rest)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), F.size("body")), F.array_repeat(F.lit(0), rest)).alias("attention_mask"),
        )
    )
