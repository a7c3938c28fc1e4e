"""Articles: normalising, merging queries, scoring hooks, daily aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axis import Axis, number_rows
from ..functions.quantiles import column_quantiles
from ..operators.clean import article_text, keep_first
from ..session import written

C = F.col

ARTICLE_SCHEMA = (
    "source struct<id: string, name: string>, author string, title string, description string, "
    "url string, urlToImage string, publishedAt string, content string"
)
ARTICLE_COLUMNS = ("publishedAt", "source_name", "author", "title", "description", "content", "url", "urlToImage")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return normalise_articles(spark.read.schema(ARTICLE_SCHEMA).json(path))


def normalise_articles(df: DataFrame) -> DataFrame:
    """Parse the time, lift ``source.name``, keep the known columns that exist."""
    df = df.withColumn("source_name", C("source")["name"])
    if dict(df.dtypes)["publishedAt"] == "string":
        df = df.withColumn("publishedAt", F.try_to_timestamp("publishedAt"))
    return df.select(*[c for c in ARTICLE_COLUMNS if c in df.columns], *[c for c in df.columns if c not in (*ARTICLE_COLUMNS, "source")])


def merge_queries(results: Sequence[DataFrame] | DataFrame, query_ix: str = "query_ix") -> DataFrame:
    """Union of several query results, one article per url (earliest query, then earliest time)."""
    if not isinstance(results, DataFrame):
        tagged = [r.withColumn(query_ix, F.lit(i)) for i, r in enumerate(results)]
        results = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_first(results, ["url"], [query_ix, "publishedAt"])


# ------------------------------------------------------------ scoring hooks

NEUTRAL = (0.0, 1.0, 0.0, 0.0)
Scorer = Callable[[list[str]], list[tuple[float, float, float]]]


def score_articles(df: DataFrame, load_scorer: Callable[[], Scorer] | None = None, batch: int = 16, cols: Sequence[str] = ("title", "description")) -> DataFrame:
    """Add negative / neutral / positive / compound.

    ``load_scorer`` runs once per worker process and returns a function from a
    batch of texts to (negative, neutral, positive); without one, or for empty
    text, the row is neutral.
    """
    df = article_text(df, cols, "_text")
    names = ("negative", "neutral", "positive", "compound")
    if load_scorer is None:
        return df.drop("_text").withColumns({n: F.lit(v) for n, v in zip(names, NEUTRAL)})

    @F.pandas_udf("negative double, neutral double, positive double, compound double")
    def score(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for texts in chunks:
            rows = [NEUTRAL] * len(texts)
            full = [i for i, t in enumerate(texts) if t and t.strip()]
            for at in range(0, len(full), batch):
                part = full[at : at + batch]
                for i, (neg, neu, pos) in zip(part, scorer([texts.iloc[i] for i in part])):
                    rows[i] = (neg, neu, pos, pos - neg)
            yield pd.DataFrame(rows, columns=list(names))

    return df.withColumn("_s", score("_text")).select(*[c for c in df.columns if c != "_text"], "_s.*")


def score_with_model(df: DataFrame, load_model: Callable[[], Callable[[str], float]] | None = None, out: str = "llm_sentiment") -> DataFrame:
    """One score per article from a user model, clamped to [-1, 1]; a failing call scores 0."""
    if load_model is None:
        return df.withColumn(out, F.lit(0.0))

    @F.pandas_udf("double")
    def score(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()

        def one(text: str) -> float:
            try:
                return max(-1.0, min(1.0, float(model(text))))
            except Exception:  # noqa: BLE001 - a failing model call must not fail the job
                return 0.0

        for texts in chunks:
            yield texts.map(one)

    parts = F.concat_ws(" ", F.coalesce(C("title"), F.lit("")), F.coalesce(C("description"), F.lit("")))
    return df.withColumn(out, score(parts))


def daily_article_sentiment(df: DataFrame, key: Sequence[str] = ("symbol",), ts: str = "publishedAt", start=None, end=None) -> DataFrame:
    """Daily means of the four scores, article count, and compound weighted by ln(1 + count)."""
    day = C(ts).cast("date")
    if start is not None:
        df = df.filter(day >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(day <= F.lit(end).cast("date"))
    means = [F.avg(c).alias(f"sentiment_{c}") for c in ("negative", "neutral", "positive", "compound")]
    out = df.groupBy(*key, day.alias("date")).agg(*means, F.count("title").alias("article_count"))
    return out.withColumn("weighted_sentiment", C("sentiment_compound") * F.log1p("article_count"))


def daily_model_sentiment(df: DataFrame, score: str = "llm_sentiment", key: Sequence[str] = ("symbol",), ts: str = "publishedAt") -> DataFrame:
    """Daily mean, median, deviation and count of model scores.

    The median is selected by sketch and exact counts, so a day of any size keeps no state per score.
    """
    keys = [*key, "date"]
    rows = df.select(*key, C(ts).cast("date").alias("date"), C(score).alias("_s"))
    out = rows.groupBy(*keys).agg(
        F.avg("_s").alias("llm_sentiment_mean"), F.coalesce(F.stddev_samp("_s"), F.lit(0.0)).alias("llm_sentiment_std"), F.count("_s").alias("llm_sentiment_count")
    )
    middle = column_quantiles(rows, keys, ["_s"], {"llm_sentiment_median": 0.5}).select(*[C(k).alias(f"_k{i}") for i, k in enumerate(keys)], "llm_sentiment_median")
    same = reduce(lambda a, b: a & b, [C(k).eqNullSafe(C(f"_k{i}")) for i, k in enumerate(keys)])
    return out.join(middle, same, "left").select(*keys, *[f"llm_sentiment_{c}" for c in ("mean", "median", "std", "count")])


def summarise_days(
    df: DataFrame,
    summarise: Callable[[list[str]], str] | None = None,
    key: Sequence[str] = ("symbol",),
    ts: str = "publishedAt",
    text: str | Sequence[str] = ("title", "description"),
    per_call: int = 100,
    tie: Sequence[str] = ("url",),
) -> DataFrame:
    """Attach a per-day summary to every article; without a summariser it is empty.

    An article's text is its ``text`` columns (those that are there), joined by blanks. A day's texts go to the summariser in
    order of time, ``tie`` and text. A day of up to ``per_call`` articles is one call; a longer one is summarised in
    stretches of ``per_call``, and their summaries again in their order until one is left, so no call and no task holds
    more, and every run gives the same summaries.
    """
    if summarise is None:
        return df.withColumn("daily_summary", F.lit(""))
    named = [c for c in ([text] if isinstance(text, str) else text) if c in df.columns]
    ties = [c for c in tie if c in df.columns]
    # keys of days as one text, missing ones included
    day = F.to_json(F.struct(*[C(k).cast("string").alias(f"k{i}") for i, k in enumerate(key)], C(ts).cast("date").alias("day")))
    df = df.withColumn("_day", day)
    texts = df.select("_day", C(ts).alias("_ts"), *[C(c).alias(f"_o{i}") for i, c in enumerate(ties)], F.concat_ws(" ", *[F.coalesce(C(c), F.lit("")) for c in named]).alias("_text"))
    order = Axis(("_day",), "_ts", (*[f"_o{i}" for i in range(len(ties))], "_text"))
    level = number_rows(texts, order, "_rn", count="_n").select("_day", "_rn", "_n", "_text")
    longest = level.agg(F.max("_n")).first()[0] or 0

    def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_rn")
        day, rn, n = rows[["_day", "_rn", "_n"]].iloc[0]
        return pd.DataFrame({"_day": [day], "_rn": [rn // per_call], "_n": [-(-n // per_call)], "_text": [summarise(rows["_text"].tolist())]})

    found = None
    while True:
        # written, as the summaries of a level are both kept and read on, and each is one call
        level = written(level.groupBy("_day", F.floor(C("_rn") / per_call).alias("_part")).applyInPandas(stretch, "_day string, _rn long, _n long, _text string"))
        done = level.filter(C("_n") <= 1).select("_day", C("_text").alias("daily_summary"))
        found = done if found is None else found.unionByName(done)
        longest = -(-longest // per_call)
        if longest <= 1:
            break
        level = level.filter(C("_n") > 1)
    return df.join(found, "_day", "left").withColumn("daily_summary", F.coalesce("daily_summary", F.lit(""))).drop("_day")
