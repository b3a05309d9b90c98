"""Data-quality jobs (DQ-2..5): quarantines.

The reference validates one request at a time and stops at the first error.
Here every rule is a column expression and each row collects an array of the
reasons it fails, so a whole table is checked in one pass:
``accepted = rows with no reason``, ``quarantine = rows with reasons`` and
accepted + quarantined = input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.patterns import (ADDRESS, HOUR_MINUTE, LATITUDE, LONGITUDE, PERSIAN_NAME, PLACE_NAME,
                                         YEAR_MONTH_DAY, anchored)


# ------------------------------------------------------------------ DQ-2..5

def national_id_ok(c: Column) -> Column:
    """Iranian national id: 10 digits (spaces / dashes ignored), not all the
    same digit, weighted mod-11 check digit."""
    code = F.regexp_replace(c, r"[\s\-]", "")

    # A lambda's argument is computed once however often it is named.
    def check(d):
        digit = [F.ascii(F.substring(d, i, 1)) - 48 for i in range(1, 11)]
        total = sum((digit[i] * (10 - i) for i in range(9)), F.lit(0))
        control = F.transform(F.array(total % 11), lambda rem: F.when(rem < 2, rem).otherwise(11 - rem))
        return F.when(d.rlike(r"^\d{10}$") & ~d.rlike(r"^(\d)\1{9}$"), digit[9] == control[0]).otherwise(False)

    return F.transform(F.array(code), check)[0]


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(txt)) for cond, txt in pairs]),
                    lambda x: x.isNotNull())


def validate_users(raw: DataFrame, users: DataFrame, key: str = "row_id", *, secret: str):
    """DQ-2: registration rows to (accepted, quarantine); see ``check_users``."""
    out = check_users(raw, users, key, secret=secret)
    return out.filter(F.size("reasons") == 0), out.filter(F.size("reasons") > 0)


def keyed_hash(c: Column, secret: str) -> Column:
    """SHA-256 over the secret, the value's SHA-256 under it, and the secret."""
    inner = F.sha2(F.concat(F.lit(secret + ":"), c), 256)
    return F.sha2(F.concat(F.lit(secret + ":"), inner), 256)


def check_users(raw: DataFrame, users: DataFrame, key: str = "row_id",
                *, secret: str) -> DataFrame:
    """DQ-2: every registration row with its array of failed rules (one pass).

    Rules: first and last name of 2-25 Persian letters or spaces; phone of 11
    digits starting 09; national id valid (see ``national_id_ok``); phone and
    national id not already held by a user, nor by an earlier row of the same
    batch that passes all of these (lowest ``key`` wins). National ids leave
    only as a keyed hash: without ``secret`` the 10 digits cannot be found by
    trying them all. Passwords are not handled here.
    """
    phones = users.select(F.col("phone").alias("_p")).distinct()
    nids = users.select(F.col("national_id").alias("_n")).distinct()
    has_phone, has_nid = F.col("phone") == F.col("_p"), F.col("national_id") == F.col("_n")
    # The rules of a row alone, below the joins: there they run over the input's own
    # partitions, whatever rows share a phone or an id.
    r = raw.withColumn("_own", _reasons(
        (~F.coalesce(F.col("first_name").rlike(anchored(PERSIAN_NAME)), F.lit(False)), "first_name"),
        (~F.coalesce(F.col("last_name").rlike(anchored(PERSIAN_NAME)), F.lit(False)), "last_name"),
        (~F.coalesce(F.col("phone").rlike(r"^09\d{9}$"), F.lit(False)), "phone"),
        (~national_id_ok(F.col("national_id")), "national_id")))
    # A row that another rule rejects holds no phone or id against later rows.
    valid = (r.filter(F.size("_own") == 0).select(key, "phone", "national_id")
             .join(phones, has_phone, "left_anti").join(nids, has_nid, "left_anti"))
    first_p = valid.groupBy("phone").agg(F.min(key).alias("_fp"))
    first_n = valid.groupBy("national_id").agg(F.min(key).alias("_fn"))
    # What a phone or an id is known for, side by side: one join each.
    by_phone = phones.withColumn("_p_taken", F.lit(True)).join(
        first_p.withColumnRenamed("phone", "_fp_of"), F.col("_p") == F.col("_fp_of"), "full").select(
        F.coalesce("_p", "_fp_of").alias("_p"), "_p_taken", "_fp")
    by_nid = nids.withColumn("_n_taken", F.lit(True)).join(
        first_n.withColumnRenamed("national_id", "_fn_of"), F.col("_n") == F.col("_fn_of"), "full").select(
        F.coalesce("_n", "_fn_of").alias("_n"), "_n_taken", "_fn")
    r = r.join(by_phone, has_phone, "left").join(by_nid, has_nid, "left")
    taken = _reasons((F.coalesce("_p_taken", F.lit(False)), "phone_taken"),
                     (F.coalesce("_n_taken", F.lit(False)), "national_id_taken"))
    repeated = _reasons((F.coalesce(F.col(key) > F.col("_fp"), F.lit(False)), "phone_repeated"),
                        (F.coalesce(F.col(key) > F.col("_fn"), F.lit(False)), "national_id_repeated"))
    return (r.withColumn("reasons", F.concat("_own", taken, repeated))
            .withColumn("national_id", keyed_hash(F.col("national_id"), secret))
            .drop("_p", "_n", "_p_taken", "_n_taken", "_own", "_fp", "_fn"))


def missing(c: Column, is_bool: bool = False) -> Column:
    """DQ-4 emptiness: NULL, or empty text; '0' and booleans never count."""
    if is_bool:
        return F.lit(False)
    s = c.cast("string")
    return c.isNull() | ((F.trim(s) == "") & (s != "0"))


def require(df: DataFrame, cols: list[str], groups: list[list[str]] | None = None,
            out: str = "missing") -> DataFrame:
    """DQ-4: names of required columns that are missing, plus a
    ``one_of:a|b`` entry for each group of which no member is present."""
    types = dict(df.dtypes)
    pairs = [(missing(F.col(c), types[c] == "boolean"), c) for c in cols]
    for g in groups or []:
        none = F.lit(True)
        for c in g:
            none = none & missing(F.col(c), types[c] == "boolean")
        pairs.append((none, "one_of:" + "|".join(g)))
    return df.withColumn(out, _reasons(*pairs))


def validate_members(df: DataFrame):
    """DQ-5: group-member rows to (accepted, quarantine); see ``check_members``."""
    r = check_members(df)
    return r.filter(F.size("missing") == 0), r.filter(F.size("missing") > 0)


def check_members(df: DataFrame) -> DataFrame:
    """DQ-5: group-member rows with the list of problems (one pass): four
    required fields, and the birth date (Jalali or Gregorian text) converted
    to a date (``birth_date_format`` when it does not convert)."""
    from eventide.functions.calendar import normalise_dates
    r = require(df, ["first_name", "last_name", "birth_date", "national_id"])
    r = normalise_dates(r, "birth_date", out="birth_date_g")
    r = r.withColumn("missing", F.when(F.col("birth_date_g").isNull()
                                       & ~F.array_contains("missing", "birth_date"),
                                       F.array_append("missing", F.lit("birth_date_format")))
                     .otherwise(F.col("missing")))
    return r


MOST_CAPACITY = 65_535  # fixed value: the column is an unsigned 16-bit number


def validate_events(raw: DataFrame, categories: DataFrame, medias: DataFrame,
                    leaders: DataFrame, users: DataFrame, as_of: str,
                    checked: bool = False):
    """DQ-3: event submissions to (accepted rows shaped as events, quarantine).

    Input columns: sub_id, creator_id, title, category, start_date (Jalali or
    Gregorian text), start_time (HH:MM), end_date, end_time, location_name,
    address, coordinate_lat, coordinate_lng, coordinate_address, description,
    media_ids (comma list of media uuids), capacity, grouping, price,
    private, approval, leader (admin only).

    With ``checked=True`` returns one frame of every submission with its
    reasons instead of the split.

    Rules as the reference: title 5-150 chars, description 20-2000, category
    exists, date / time formats, start >= as-of, end > start, place and
    address patterns, coordinates (longitude limit 180, the reference's 90 is
    a copy slip), an image among the media (the first image in list order is
    the thumbnail), capacity an integer from 1 to 65535, grouping equal to capacity
    becomes 0, above capacity or not dividing it is rejected; price digits or
    0; status verified when the creator is an admin, else pending; an admin
    may name another leader.
    """
    from eventide.functions.calendar import normalise_dates
    from eventide.operators.windows import first_image

    r = normalise_dates(raw, "start_date", out="_sd")
    r = normalise_dates(r, "end_date", out="_ed")

    def at(d, tm):
        # only a time that passes the HH:MM rule is read (the reference stops
        # at a bad time, so no later rule judges it)
        return F.when(F.col(tm).rlike(anchored(HOUR_MINUTE)), F.try_to_timestamp(
            F.concat_ws(" ", F.col(d).cast("string"), F.col(tm)), F.lit("yyyy-MM-dd H:mm")))

    r = r.withColumn("_start", at("_sd", "start_time").cast("timestamp_ntz")).withColumn(
        "_end", at("_ed", "end_time").cast("timestamp_ntz"))
    lists = r.select(F.col("sub_id").alias("row_id"),
                     F.transform(F.split("media_ids", ","), lambda x: F.trim(x)).alias("uuids"))
    med = medias.select("uuid", "id", "type")
    ids = (lists.select("row_id", F.posexplode("uuids").alias("pos", "uuid"))
           .join(med, "uuid").groupBy("row_id")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))),
                            lambda x: x["id"]).alias("media_id_list")))
    thumbs = first_image(ids, med.drop("uuid"), "media_id_list", "row_id")
    cats = categories.select(F.col("id").alias("_cat"), F.lit(True).alias("_cat_ok"))
    roles = users.select(F.col("id").alias("creator_id"), F.col("role").alias("_role"))
    own = leaders.select(F.col("user_id").alias("creator_id"), F.col("id").alias("_own_leader"))
    named = leaders.select(F.col("id").alias("_named"), F.lit(True).alias("_named_ok"))
    r = (r.join(thumbs.withColumnRenamed("row_id", "sub_id"), "sub_id", "left")
         .join(cats, F.col("category").try_cast("long") == F.col("_cat"), "left")
         .join(roles, "creator_id", "left").join(own, "creator_id", "left")
         .join(named, F.col("leader").try_cast("long") == F.col("_named"), "left"))
    # Whole numbers without leading zeros; what does not fit is no number.
    whole = r"^\s*(0|[1-9][0-9]*)\s*$"
    cap = F.col("capacity").cast("string")
    cap_i = F.when(cap.rlike(whole), F.trim(cap).try_cast("long"))
    group = F.col("grouping").cast("string")
    grp = F.coalesce(F.when(group.rlike(whole), F.trim(group).try_cast("long")), F.lit(0))
    price_digits = F.regexp_replace(F.coalesce(F.col("price").cast("string"), F.lit("")),
                                    r"\D", "")
    now = F.lit(as_of).cast("timestamp_ntz")
    is_admin = F.coalesce(F.col("_role") == "admin", F.lit(False))
    leader_id = F.when(is_admin & F.col("_named_ok").isNotNull(), F.col("_named")).otherwise(
        F.col("_own_leader"))
    n_title = F.char_length(F.col("title"))
    n_desc = F.char_length(F.col("description"))
    reasons = _reasons(
        (~F.coalesce(n_title.between(5, 150), F.lit(False)), "title_length"),
        (F.col("_cat_ok").isNull(), "category"),
        (~F.coalesce(F.col("start_date").rlike(anchored(YEAR_MONTH_DAY)), F.lit(False)) | F.col("_sd").isNull(),
         "start_date"),
        (~F.coalesce(F.col("start_time").rlike(anchored(HOUR_MINUTE)), F.lit(False)), "start_time"),
        (~F.coalesce(F.col("end_date").rlike(anchored(YEAR_MONTH_DAY)), F.lit(False)) | F.col("_ed").isNull(),
         "end_date"),
        (~F.coalesce(F.col("end_time").rlike(anchored(HOUR_MINUTE)), F.lit(False)), "end_time"),
        (F.coalesce(F.col("_start") < now, F.lit(False)), "start_in_past"),
        (F.coalesce(F.col("_end") <= F.col("_start"), F.lit(False)), "end_before_start"),
        (~F.coalesce(F.col("location_name").rlike(anchored(PLACE_NAME)), F.lit(False)),
         "location_name"),
        (~F.coalesce(F.col("address").rlike(anchored(ADDRESS)), F.lit(False)), "address"),
        (~F.coalesce(F.col("coordinate_lat").cast("string").rlike(anchored(LATITUDE)), F.lit(False)), "lat"),
        (~F.coalesce(F.col("coordinate_lng").cast("string").rlike(anchored(LONGITUDE)), F.lit(False)), "lng"),
        (~F.coalesce(F.col("coordinate_address").rlike(anchored(ADDRESS)), F.lit(False)),
         "coordinate_address"),
        (~F.coalesce(n_desc.between(20, 2000), F.lit(False)), "description_length"),
        (F.col("thumbnail_id").isNull(), "no_image"),
        (~F.coalesce(cap_i.between(1, MOST_CAPACITY), F.lit(False)), "capacity"),
        ((grp > 0) & (grp != cap_i) & ((grp > cap_i) | (cap_i % F.greatest(grp, F.lit(1)) != 0)),
         "grouping"),
        ((F.col("price").isNotNull() & (F.col("price").cast("string") != "")
          & (F.col("price").cast("string") != "0")
          & ~F.coalesce(price_digits.try_cast("long") > 0, F.lit(False))), "price"),
        (leader_id.isNull(), "leader"),
    )
    r = r.withColumn("reasons", reasons)
    if checked:  # every submission with its reasons, in one pass
        return r.select("sub_id", "reasons", "thumbnail_id",
                        F.when(is_admin, "verified").otherwise("pending").alias("status"),
                        leader_id.alias("leader_id"),
                        F.when(grp == cap_i, 0).otherwise(grp).try_cast("int").alias("grouping"),
                        F.col("_start").alias("start_time"))
    accepted = r.filter(F.size("reasons") == 0).select(
        "sub_id", F.col("title"), "description", F.col("_cat").alias("category_id"),
        F.col("_start").alias("start_time"), F.col("_end").alias("end_time"),
        F.col("location_name").alias("location"), "address",
        F.struct(F.col("coordinate_lat").try_cast("double").alias("lat"),
                 F.col("coordinate_lng").try_cast("double").alias("lng"),
                 F.col("coordinate_address").alias("address")).alias("coordinates"),
        F.coalesce(price_digits.try_cast("long"), F.lit(0)).alias("price"),
        cap_i.try_cast("int").alias("capacity"),
        F.when(grp == cap_i, 0).otherwise(grp).try_cast("int").alias("grouping"),
        "creator_id",
        leader_id.alias("leader_id"),
        "thumbnail_id", F.when(is_admin, "verified").otherwise("pending").alias("status"),
        F.coalesce(F.col("private").cast("boolean"), F.lit(False)).alias("is_private"),
        F.coalesce(F.col("approval").cast("boolean"), F.lit(False)).alias("is_approval"),
        "media_ids")
    quarantine = r.filter(F.size("reasons") > 0).select("sub_id", "creator_id", "title",
                                                       "reasons")
    return accepted, quarantine


def ingest_events(accepted: DataFrame, events: DataFrame, medias: DataFrame, as_of: str):
    """SNK-1: accepted submissions appended as new events, and the media rows
    they name linked to them.

    New ids are the current maximum id plus the submission id (one small
    aggregate, no global numbering). Returns (new event rows, new medias
    snapshot); the caller appends / overwrites with one write each.
    """
    from eventide.functions.text import slug
    from eventide.sources.sinks import apply_updates
    top = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = (accepted.crossJoin(top)  # one-row side
           .withColumn("id", F.col("_top") + F.col("sub_id")).drop("_top")
           .withColumn("created_at", F.lit(as_of).cast("timestamp_ntz"))
           .withColumn("views", F.lit(0).cast("long")))
    new = slug(new, "title", "start_time")  # Q02 finds an event by it
    links = (new.select(F.col("id").alias("event_id"),
                        F.explode(F.split("media_ids", ",")).alias("uuid"))
             .withColumn("uuid", F.trim("uuid"))
             .join(medias.select("uuid", "id"), "uuid")
             .select("id", "event_id", F.lit(as_of).cast("timestamp_ntz").alias("_at")))
    return new.drop("media_ids"), apply_updates(medias, links, "id", "_at")
