"""Language detection by weighted character-trigram profiles, with script and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Language codes of the multilingual interface.
SUPPORTED = "en de fr es it pt nl pl ru ja zh ko ar tr vi th id hi bn ta te mr gu kn ml pa ur fa he el cs sk hu ro bg uk hr sr sl lt lv et fi sv da no is ga cy mt".split()


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 400) -> dict[str, dict[str, float]]:
    """Log odds of the `size` most frequent trigrams of each language, from whole texts; bounded by languages times size."""
    t = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.lower(F.regexp_replace(text, r"(?U)[^\p{L}]+", " ")).alias("t")).where(F.length("t") >= 3)
    grams = t.select("lang", F.explode(F.regexp_extract_all("t", F.lit("(?s)(?=(.{3}))"), 1)).alias("g")).groupBy("lang", "g").count()
    from pyspark.sql import Window as W

    top = grams.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "g"))).where(F.col("r") <= size)
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    import math

    out: dict[str, dict[str, float]] = {k: {} for k in totals}
    for r in top.collect():
        out[r["lang"]][r["g"]] = math.log((r["count"] + 0.5) / totals[r["lang"]])
    return out


def detect(text: Column, profiles: dict[str, dict[str, float]], min_confidence: float = 0.5) -> Column:
    """Struct language, confidence: under ten visible characters 'unknown' and 0; the best language of the first 1000 characters, 'unknown' under min_confidence."""
    import math

    langs = sorted(profiles)

    @F.pandas_udf("language string, confidence double")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            t = " ".join((t or "").split())
            if len(t) < 10 or not langs:
                out.append(("unknown", 0.0))
                continue
            x = "".join(c if c.isalpha() else " " for c in t[:1000].lower())
            grams = [x[i : i + 3] for i in range(len(x) - 2)]
            score = [sum(p.get(g, -12.0) for g in grams) for p in (profiles[k] for k in langs)]
            top = max(score)
            weights = [math.exp(max(-700.0, v - top)) for v in score]
            p = 1 / sum(weights)
            out.append((langs[score.index(top)] if p >= min_confidence else "unknown", p))
        return pd.DataFrame(out, columns=["language", "confidence"])

    return run(strip(F.coalesce(text, F.lit(""))))


def detect_simple(text: Column, profiles: dict[str, dict[str, float]]) -> Column:
    """The best language whatever its confidence."""
    return detect(text, profiles, 0.0)["language"]
