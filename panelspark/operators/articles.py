"""News articles: clean, deduplicate, score and audit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions import text as T
from panelspark.operators.sampling import mixed


def union_sources(feeds: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Several feeds under one schema, each row tagged with its source."""
    tagged = [feed.withColumn("src", F.lit(tag)) for tag, feed in feeds]
    out = tagged[0]
    for other in tagged[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def keep_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of universe members only; the list side is left to adaptive broadcast."""
    listed = members.select(T.symbol_of(F.col("symbol")).alias("symbol")).distinct()
    return rows.join(listed, "symbol", "left_semi")


def clean(raw: DataFrame) -> DataFrame:
    """Raw text columns symbol, ts, title, body, url, src to a normalised article row.

    Row-local expressions only. The body is reduced to a flag here, so it never takes
    part in a shuffle.
    """
    title = T.title_or_lead(F.col("title"), F.col("body"))
    body = T.strip(F.coalesce(F.col("body"), F.lit("")))
    staged = (raw.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
              .select(T.symbol_of(F.col("symbol")).alias("symbol"), T.strip(F.col("ts")).alias("ts"),
                      T.stated_date_text(F.col("ts")).alias("date"), title.alias("title"),
                      (F.length(body) > params.MIN_BODY_CHARS).alias("has_body"),
                      T.normal_url(F.col("url")).alias("nurl"), "src"))
    return (staged.where(F.col("date").isNotNull() & (F.length("title") > 0))
            .withColumn("ntitle", T.normal_title(F.col("title"))))


STRICT_KEY = ("symbol", "date", "ntitle", "nurl")


def strict_dedup(articles: DataFrame, source_order: Sequence[str]) -> DataFrame:
    """One article per (symbol, date, normalised title, normalised URL).

    The survivor is the first by source order, then timestamp, title and body flag. An
    aggregation picks it, so a story copied millions of times is reduced to one row per
    task before the shuffle.
    """
    priority = F.coalesce(F.array_position(F.lit(list(source_order)), F.col("src")), F.lit(0))
    priority = F.when(priority == 0, len(source_order) + 1).otherwise(priority)
    rest = [c for c in articles.columns if c not in STRICT_KEY]
    order = F.struct(priority, *[F.col(c) for c in ("ts", "title", "has_body") if c in rest])
    return (articles.groupBy(*STRICT_KEY)
            .agg(F.min_by(F.struct(*rest), order).alias("_row"))
            .select(*STRICT_KEY, "_row.*"))


def over_merge_rate(raw: DataFrame, title_chars: int = params.LOOSE_TITLE_CHARS) -> DataFrame:
    """How many stories a loose key (leading title characters, no URL) would merge.

    Loose keys are counted on the distinct strict keys, so one chain of two combining
    aggregations replaces two distinct counts over the raw rows.
    """
    strict = raw.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull() & F.col("title").isNotNull()).select(
        T.strip(F.col("symbol")).alias("symbol"), F.substring("ts", 1, 10).alias("d10"),
        T.strip(F.col("title")).alias("title"), F.coalesce("url", F.lit("")).alias("url")).distinct()
    loose = strict.groupBy("symbol", "d10", F.substring("title", 1, title_chars).alias("head")).agg(
        F.count(F.lit(1)).alias("stories"))
    return loose.agg(
        F.count(F.lit(1)).alias("loose"), F.coalesce(F.sum("stories"), F.lit(0)).alias("strict"),
        (1 - F.try_divide(F.count(F.lit(1)), F.sum("stories"))).alias("rate"))


def lexicon_sign(text: Column, positive: Sequence[str] = params.POSITIVE_WORDS,
                 negative: Sequence[str] = params.NEGATIVE_WORDS) -> Column:
    words = T.words(text)
    return F.signum((T.hits(words, positive) - T.hits(words, negative)).cast("double")).cast("int")


def label_of(p_pos: Column, p_neg: Column, p_neu: Column) -> Column:
    """Most probable label; ties go to pos, then neg."""
    return (F.when(p_pos >= F.greatest(p_neg, p_neu), "pos")
            .when(p_neg >= F.greatest(p_pos, p_neu), "neg").otherwise("neu"))


def long_bodies(raw: DataFrame, body_chars: int | None = None) -> DataFrame:
    """Title and body units of articles whose body is long enough to be scored itself.

    The body unit is the whole body; ``body_chars`` cuts it for a scorer that reads a prefix only.
    """
    body = T.strip(F.col("body"))
    return (raw.where(F.length("body") > params.LONG_BODY_CHARS)
            .where(F.col("symbol").isNotNull() & F.col("ts").isNotNull() & F.col("title").isNotNull())
            .select(T.strip(F.col("symbol")).alias("symbol"), F.substring("ts", 1, 10).alias("date"),
                    T.strip(F.col("title")).alias("title"),
                    (F.substring(body, 1, body_chars) if body_chars else body).alias("body")))


def join_titles(scored: DataFrame, corpus: DataFrame,
                keys: Sequence[str] = ("symbol", "ts", "ntitle", "nurl")) -> DataFrame:
    """Scored rows with their corpus title, matched on a key that is unique in the corpus."""
    return scored.join(corpus.select(*keys, "title"), list(keys), "left")


def title_fan_out(scored: DataFrame, corpus: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """What a left join of scored rows to titles on a non-unique key yields, per key.

    (symbol, ts) is a bare date, so every article of a day meets every title of that day.
    The pairs are counted from both sides' counts and never made.
    """
    left = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    right = corpus.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs"), F.count("title").alias("_titles"))
    joined = left.join(right, list(keys), "left")
    return joined.select(*keys, (F.col("_rows") * F.coalesce("_pairs", F.lit(1))).alias("rows"),
                         (F.col("_rows") * F.coalesce("_titles", F.lit(0))).alias("titles"))


Scorer = Callable[[list[str]], np.ndarray]


class LexiconScorer:
    """Default text scorer: word-list hits turned into pos, neg, neu probabilities.

    A classifier with the same call (texts -> [n, 3] probabilities) can take its place.
    """

    def __init__(self, positive: Sequence[str] = params.POSITIVE_WORDS,
                 negative: Sequence[str] = params.NEGATIVE_WORDS) -> None:
        self.positive, self.negative = frozenset(positive), frozenset(negative)

    def __call__(self, texts: list[str]) -> np.ndarray:
        logits = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            words = set(text.lower().replace(",", " ").replace(".", " ").split())
            logits[i, 0], logits[i, 1] = len(words & self.positive), len(words & self.negative)
        weights = np.exp(logits - logits.max(axis=1, keepdims=True))
        return weights / weights.sum(axis=1, keepdims=True)


def score_lexicon(rows: DataFrame, column: str, positive: Sequence[str] = params.POSITIVE_WORDS,
                  negative: Sequence[str] = params.NEGATIVE_WORDS, prefix: str = "") -> DataFrame:
    """Add p_pos, p_neg, p_neu and sent_signed of the word-list scorer, in column expressions only.

    The softmax of the numbers of distinct positive words, distinct negative words, and 0. A missing text has no words.
    """
    words = T.words(F.coalesce(F.col(column), F.lit("")))
    counted = rows.withColumn("_w", words).withColumn("_h", F.struct(
        T.hits(F.col("_w"), positive).alias("pos"), T.hits(F.col("_w"), negative).alias("neg")))
    top = F.greatest(F.col("_h.pos"), F.col("_h.neg"), F.lit(0))
    parts = {n: F.exp(v - top) for n, v in (("p_pos", F.col("_h.pos")), ("p_neg", F.col("_h.neg")), ("p_neu", F.lit(0)))}
    total = parts["p_pos"] + parts["p_neg"] + parts["p_neu"]
    scored = counted.select(*rows.columns, *[(v / total).cast("float").alias(prefix + n) for n, v in parts.items()])
    return scored.withColumn(f"{prefix}sent_signed", F.col(f"{prefix}p_pos") - F.col(f"{prefix}p_neg"))


def score_text(rows: DataFrame, column: str, make_scorer: Callable[[], Scorer] = LexiconScorer) -> DataFrame:
    """Add p_pos, p_neg, p_neu and sent_signed from a pluggable scorer.

    For the word lists themselves :func:`score_lexicon` needs no Python. An iterator pandas UDF: the scorer (a model, typically) is built once per task and
    sees Arrow batches of whole texts. Only the text column crosses to Python.
    """
    @F.pandas_udf("struct<p_pos:float,p_neg:float,p_neu:float>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            scores = scorer(batch.fillna("").tolist()) if len(batch) else np.zeros((0, 3))
            yield pd.DataFrame(scores.astype("float32"), columns=["p_pos", "p_neg", "p_neu"])

    scored = rows.withColumn("_p", probabilities(F.col(column)))
    return (scored.select(*rows.columns, "_p.*")
            .withColumn("sent_signed", F.col("p_pos") - F.col("p_neg")))


def sign_agreement(df: DataFrame, a: str, b: str, decided: bool = False) -> DataFrame:
    """Share of rows whose signs are equal, and their number; with ``decided`` of rows where ``b`` is not zero."""
    if decided:
        df = df.where(F.col(b) != 0)
    return df.agg(F.avg((F.signum(F.col(a).cast("double")) == F.signum(F.col(b).cast("double"))).cast("int"))
                  .alias("agreement"), F.count(F.lit(1)).alias("n"))


def date_only_share(news: DataFrame) -> DataFrame:
    """Per stated year: articles and the share whose timestamp is a bare date."""
    year = F.year(T.stated_date_text(F.col("ts")).try_cast("date"))
    return (news.select(year.alias("year"), T.date_only(F.col("ts")).alias("bare"))
            .where(F.col("year").isNotNull()).groupBy("year")
            .agg(F.count(F.lit(1)).alias("articles"), F.avg(F.col("bare").cast("int")).alias("frac")))


def stratified_sample(rows: DataFrame, label: str, key: str, per_label: int = 70, seed: int = 1) -> DataFrame:
    """Up to ``per_label`` rows of each label, in a repeatable pseudo-random order.

    Every task keeps its own first rows of a label before anything is shuffled, so a label of any size
    sends ``per_label`` rows per task and no more. Rows equal in key are as good as each other.
    """
    order = Window.partitionBy(label).orderBy(mixed(key, seed), F.col(key))
    return rows.withColumn("_pos", F.row_number().over(order)).where(F.col("_pos") <= per_label).drop("_pos")
