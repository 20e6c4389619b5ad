"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matching_url(url: Column) -> Column:
    """Without fragment, default port and trailing slashes, parameters sorted; what isn't a URL is trimmed only."""
    t = F.trim(url)
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    scheme, host, path, query = (F.regexp_extract(t, whole, g) for g in (1, 2, 3, 4))
    scheme = F.lower(scheme)
    host = F.lower(host)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    search = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(t.rlike(whole), F.concat(scheme, F.lit("://"), host, path, search)).otherwise(F.when(t != "", t))


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)", 1))


def is_social_post(url: Column) -> Column:
    return F.regexp_replace(domain(url), r"^(www|mobile)\.", "").isin("x.com", "twitter.com") & url.rlike(r"/status/\d+")


def video_id(url: Column) -> Column:
    """The eleven characters after v=, youtu.be/, /shorts/ or /embed/."""
    return F.nullif(F.regexp_extract(url, r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)", 1), F.lit(""))


def canonical_video(url: Column) -> Column:
    """The page of a video whatever the form of its address; null for other addresses."""
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(url))


def start_seconds(url: Column) -> Column:
    """t= or start= as seconds or 1h2m3s."""
    t = F.regexp_extract(url, r"[?&#](?:t|start)=([0-9hms]+)", 1)
    part = lambda u: F.coalesce(F.nullif(F.regexp_extract(t, rf"(\d+){u}", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(t.rlike(r"^\d+$"), t.cast("int")).when(t != "", part("h") * 3600 + part("m") * 60 + part("s"))
