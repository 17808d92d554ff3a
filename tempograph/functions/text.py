"""Search terms, mail and places as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempograph.functions.scalars import KM_PER_DEGREE

#: Words that say nothing about what is searched for (fixed values).
STOP_WORDS = """a all also an and any are as at be been but by can could did do does find for from get give had has have
her him his how i if in into is it its just know look may me might must my need no not now of on or our out over please
shall she so some tell than that the their them then there these they this those to too under up was we were what when
where which who whom why will with would you your""".split()
#: Senders of bulk mail (fixed values).
BULK_SENDERS = "mailchimp.com hubspot.com mailerlite.com constantcontact.com campaignmonitor.com elasticemail.com mail.marketing email-od.com".split()


def without_possessives(text: Column) -> Column:
    return F.regexp_replace(text, "['’][sS]", " ")


def salient(text: Column, most: int = 8) -> Column:
    """The first different words of two letters or more that say something, as they are first written."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(STOP_WORDS))
    low = F.transform(words, lambda w: F.lower(w))
    first = F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    return F.slice(first, 1, most)


def sender_domain(sender: Column) -> Column:
    """The part behind the last @; null if there is none."""
    domain = F.lower(F.rtrim(F.btrim(F.regexp_extract(sender, "@([^@]*)$", 1)), F.lit(">")))
    return F.nullif(domain, F.lit(""))


def bulk_mail(sender: Column, has_unsubscribe: Column) -> Column:
    """Mail that names a way to unsubscribe, or comes from a bulk sender's domain or one below it."""
    domains = "|".join(d.replace(".", r"\.") for d in BULK_SENDERS)
    return has_unsubscribe | F.coalesce(sender_domain(sender).rlike(rf"^(.*\.)?({domains})$"), F.lit(False))


def place_label(latitude: Column, longitude: Column) -> Column:
    """The cell of a thousandth of a degree in which a place lies."""
    cell = lambda x: F.format_string("%.3f", F.round(x * 1000).cast("long") / 1000)
    return F.concat(cell(latitude), F.lit(", "), cell(longitude))


def box(latitude: Column, longitude: Column, km: float) -> Column:
    """min_lat, max_lat, min_lon, max_lon around a place; all longitudes where it reaches a pole or the date line."""
    south, north = F.greatest(latitude - km / KM_PER_DEGREE, F.lit(-90.0)), F.least(latitude + km / KM_PER_DEGREE, F.lit(90.0))
    wide = km / (KM_PER_DEGREE * F.greatest(F.abs(F.cos(F.radians(latitude))), F.lit(1e-12)))
    all_ = (north >= 90) | (south <= -90) | (longitude - wide < -180) | (longitude + wide > 180)
    return F.struct(south.alias("min_lat"), north.alias("max_lat"), F.when(all_, -180.0).otherwise(longitude - wide).alias("min_lon"), F.when(all_, 180.0).otherwise(longitude + wide).alias("max_lon"))


def backoff(attempt: Column, base_s: float, most_s: float) -> Column:
    """Doubling wait after the n-th attempt."""
    return F.least(base_s * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(60))), F.lit(most_s))
