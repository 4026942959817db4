"""Checks of records before they are used: videos, profiles, payloads with secrets, places, identities."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of sensitive keys (fixed values).
SENSITIVE = ["password", "secret", "token", "api_key", "apikey", "auth", "authorization", "credential", "private_key", "session", "cookie", "csrf", "jwt", "bearer", "access_token", "refresh_token"]
HIDDEN, LONGEST, MOST_ITEMS = "[REDACTED]", 10_000, 100
#: Scores to percentiles, percentiles to classes and to citations in five years (fixed values).
PERCENTILES = [(0.90, 99), (0.80, 95), (0.70, 90), (0.60, 80), (0.50, 70), (0.40, 55), (0.30, 40), (0.20, 25), (0.10, 10), (0.0, 5)]
IMPACT_CLASSES = [(95, "exceptional"), (80, "high"), (60, "above_average"), (40, "average"), (0, "below_average")]
CITATIONS = [(99, 500), (95, 200), (90, 100), (80, 50), (70, 30), (55, 15), (40, 8), (25, 4), (10, 2), (5, 1)]


def video_check(duration: Column, width: Column, height: Column, fps: Column, shortest: float = 1.0, longest: float = 600.0) -> Column:
    """struct(valid, errors, warnings, quality): too short is an error; very long, small or slow ones are warned of; quality is the
    mean of the resolution against 1920 x 1080 and 1 for up to a minute, else 0.7."""
    errors = F.array_compact(F.array(F.when(duration < shortest, "too short")))
    warnings = F.array_compact(F.array(F.when(duration > longest, "very long"), F.when((width < 320) | (height < 240), "low resolution"), F.when(fps < 15, "low frame rate")))
    quality = (F.least(F.lit(1.0), width * height / (1920 * 1080)) + F.when(duration.between(shortest, 60), 1.0).otherwise(0.7)) / 2
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"), quality.alias("quality"))


def profile_check(username: Column, followers: Column, following: Column) -> Column:
    """struct(valid, errors): missing (null) fields, and a negative number of followers."""
    errors = F.array_compact(F.array(
        F.when(username.isNull(), "missing username"), F.when(followers.isNull(), "missing follower_count"), F.when(following.isNull(), "missing following_count"), F.when(followers < 0, "invalid follower count")))
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"))


def sanitized(depth: int = 10):
    """A vectorised function from JSON text to JSON text with sensitive keys hidden at every level down to depth, objects below
    cut, long texts and lists cut. What is no JSON object becomes null."""
    def clean(x: dict, left: int) -> dict:
        if left <= 0:
            return {"_truncated": True}
        out = {}
        for k, v in x.items():
            if any(s in k.lower() for s in SENSITIVE):
                out[k] = HIDDEN
            elif isinstance(v, dict):
                out[k] = clean(v, left - 1)
            elif isinstance(v, list):
                out[k] = [clean(i, left - 1) if isinstance(i, dict) else i for i in v[:MOST_ITEMS]]
            elif isinstance(v, str) and len(v) > LONGEST:
                out[k] = v[:LONGEST] + "...[TRUNCATED]"
            else:
                out[k] = v
        return out

    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        def one(text):
            try:
                x = json.loads(text)
            except (TypeError, ValueError):
                return None
            return json.dumps(clean(x, depth), separators=(",", ":")) if isinstance(x, dict) else None

        return bodies.map(one)

    return run


def places(posts: DataFrame, key: str, body: str = "location") -> DataFrame:
    """(key, location_id, name, lat, lng) of JSON places that write either lat and lng or latitude and longitude; (0, 0) is no place."""
    d = posts.select(key, F.from_json(body, "struct<id:string,name:string,lat:double,lng:double,latitude:double,longitude:double>").alias("d")).filter("d IS NOT NULL")

    def first(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"d.{a}"), F.lit(0.0)), F.col(f"d.{b}"), F.lit(0.0))

    rows = d.select(key, F.coalesce("d.id", F.lit("")).alias("location_id"), F.coalesce("d.name", F.lit("Unknown")).alias("name"), first("lat", "latitude").alias("lat"), first("lng", "longitude").alias("lng"))
    return rows.filter("lat <> 0 OR lng <> 0")


def paper_identity(doi: Column, source_id: Column, title: Column) -> Column:
    """The first of DOI, source's id and the title's first 50 characters that isn't empty; null if all are."""
    def some(c: Column) -> Column:
        return F.nullif(F.coalesce(c, F.lit("")), F.lit(""))

    return F.coalesce(some(doi), some(source_id), some(F.substring(title, 1, 50)))


def impact_class(score: Column) -> Column:
    """struct(percentile, impact_class, citations) of a score from 0 to 1."""
    from .scoring import ladder

    percentile = ladder(score, PERCENTILES, 5)
    return F.struct(percentile.alias("percentile"), ladder(percentile, IMPACT_CLASSES, "below_average").alias("impact_class"), ladder(percentile, CITATIONS, 1).alias("citations"))
