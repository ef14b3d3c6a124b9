"""Tokens and normalised words as JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The token pattern and the function words must equal those whose results are matched.
TOKEN_PATTERN = "[a-zA-Zа-яА-ЯёЁ0-9]+"
STOPWORDS = (
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "к",
    "у", "же", "вы", "за", "бы", "по", "только", "ее", "мне", "было", "вот", "от", "меня", "еще", "нет", "о", "из", "ему", "теперь",
    "когда", "даже", "ну", "вдруг", "ли", "если", "уже", "или", "ни", "быть", "был", "него", "до", "вас", "нибудь", "опять",
    "уж", "вам", "для", "их", "чтобы", "без", "при", "об",
)

#: Maximal runs of letters or digits.
WORD_PATTERN = r"[\p{L}\p{N}]+"

# Letters of the same shape, lower case; ё is е.
SHAPE_FROM = "ёaceopxy"
SHAPE_TO = "еасеорху"

Tokenizer = Callable[[Column], Column]


def tokens(text: Column, min_len: int = 2, drop_stopwords: bool = True, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Lower-case tokens in their order, repeats kept; null gives an empty array. Length is tested before stopwords."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0)), lambda t: F.lower(t))
    found = F.filter(found, lambda t: F.length(t) >= min_len)
    if drop_stopwords:
        found = F.filter(found, lambda t: ~t.isin(*stopwords))
    return found


def prefix(text: Column, length: int = 200) -> Column:
    """The first ``length`` code points, as a text encoder reads them; null is empty."""
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def lemmatize(df: DataFrame, column: str, lemmas: DataFrame, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """Replaces the tokens of array ``column`` by ``lemmas`` (token, lemma); unknown tokens and those without Cyrillic stay.

    The tokens are those before stopwords are dropped (``tokens(..., drop_stopwords=False)``). The dictionary is joined to the
    exploded tokens; then the stopwords go, themselves lemmatised. Order and repeats are kept.
    """
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    rows = keyed.select("_row", F.posexplode(column).alias("_pos", "token"))
    known = lemmas.where(F.col("token").rlike("[а-яА-ЯёЁ]")).groupBy("token").agg(F.min("lemma").alias("lemma"))
    listed = df.sparkSession.createDataFrame([(w,) for w in stopwords], "token string")
    stop = listed.join(known, "token", "left").select(F.coalesce("lemma", "token").alias("lemma")).distinct()
    done = (
        rows.join(known, "token", "left")
        .select("_row", "_pos", F.coalesce("lemma", "token").alias("lemma"))
        .join(F.broadcast(stop), "lemma", "left_anti")
        .groupBy("_row")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "lemma"))), lambda x: x["lemma"]).alias("_done"))
    )
    return keyed.join(done, "_row", "left").withColumn(column, F.coalesce("_done", F.array().cast("array<string>"))).drop("_row", "_done")


def words(text: Column) -> Column:
    """Lower-cased maximal runs of letters or digits, in order; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def same_shape_words(text: Column) -> Column:
    """``words`` with ё as е and Latin a c e o p x y as the Cyrillic letters of the same shape."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), SHAPE_FROM, SHAPE_TO), F.lit(WORD_PATTERN), F.lit(0))


def full_text(title: Column, description: Column) -> Column:
    """Title, one space, description; nulls are empty, the space stays."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
