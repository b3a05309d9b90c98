"""DQ-1: audit of the marketplace's declared constraints.

Each table is read once. A row gives one entry per key it owns, per foreign key
it holds and per column rule it breaks (one ``explode`` over the rules of its
table); the entries of all tables are united and aggregated:

1. per (key space, key), side by side: how many rows own the key, and how many rows of
   each foreign key refer to it. A key space is a table's key columns, so a primary
   key, its uniqueness and the foreign keys that point at it share one group, at most
   ``SLOTS`` of these: further ones are in a space of their own, where the keys are
   owned again (a table that many refer to is small beside them). So a group holds few
   counts and one shuffle is enough.
   Spark combines entries before the shuffle, so a key that a third of all rows
   refer to is one row per task. A column rule (NOT NULL, ENUM, CHECK) is a
   space of its own, with the ids of the rows that break it as keys;
2. per rule, over the offending keys alone: keys owned more than once, references
   to keys that no row owns, and broken column rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


@dataclass(frozen=True)
class Rule:
    table: str
    kind: str                      # pk | unique | fk | not_null | enum | range
    cols: tuple[str, ...]
    ref: tuple[str, str] | None = None   # fk target (table, column)
    values: tuple | None = None          # enum values or (lo, hi)


# The declared schema. Per table its NOT NULL columns, ENUM values,
# other UNIQUE keys and foreign keys (column: table whose id it names). Every
# table's primary key is id. References to tables that the schema does not have
# (event_types, payments, groups) name the table that is meant.
REQUIRED = {
    "users": "username first_name last_name phone password role registered_at",
    "otps": "phone code expires_at is_used page created_at",
    "event_categories": "name",
    "events": "title category_id start_time location address coordinates price capacity grouping creator_id "
              "leader_id thumbnail_id views status is_private is_approval created_at",
    "event_medias": "uuid type url created_at",
    "leaders": "user_id categories_id registered_at",
    "reservations": "event_id user_id code price find_buddy status created_at updated_at",
    "reservation_group_members": "reservation_id first_name last_name birth_date national_id registered_at",
    "transactions": "reservation_id amount status created_at updated_at",
    "discount_codes": "code discount_percent discount_max discount_constant capacity creator_id expires_on created_at",
    "support_tickets": "user_id subject code status priority created_at updated_at",
    "support_ticket_messages": "user_id read message created_at updated_at",
    "notifications": "user_id title message type urgent read created_at",
    "conversations": "is_group conversation_size status expires_on created_at",
    "conversation_participants": "conversation_id user_id reservation_id joined_at",
    "messages": "conversation_id sender_id read created_at",
    "leader_followers": "leader_id follower_id created_at",
    "ratings": "from_user_id to_user_id conversation_id score created_at",
    "reports": "reporter_id created_at",
    "memories": "uuid user_id event_id thumbnail_id status created_at updated_at",
    "memory_medias": "memory_id type url created_at",
    "memory_hashtags": "memory_id hashtag created_at",
    "memory_likes": "memory_id user_id created_at",
    "memory_comments": "memory_id user_id comment created_at",
    "memories_saved": "memory_id user_id created_at",
}
ENUMS = {
    "users": {"gender": ("male", "female"), "role": ("user", "leader", "admin")},
    "events": {"status": ("pending", "verified", "deleted", "reported")},
    "event_medias": {"type": ("image", "video")},
    "reservations": {"status": ("pending-pay", "paid", "need-approval", "canceled")},
    "transactions": {"status": ("pending", "paid", "failed", "canceled")},
    "support_tickets": {"status": ("pending", " answered", "user-response", "finished"),
                        "priority": ("low", "medium", "high")},
    "notifications": {"type": ("warning", "stern-warning", "ads", "offer", "notice", "update")},
    "conversations": {"status": ("pending", "completed", "reported")},
    "memories": {"status": ("pending", "published", "deleted")},
    "memory_medias": {"type": ("image", "video")},
}
RANGES = {"ratings": {"score": (1, 5)}}
UNIQUES = {
    "users": (("username",), ("phone",), ("national_id",)),
    "leader_followers": (("leader_id", "follower_id"),),
    "memory_likes": (("memory_id", "user_id"),),
}
REFERENCES = {
    "events": {"category_id": "event_categories", "thumbnail_id": "event_medias", "creator_id": "users",
               "leader_id": "leaders"},
    "event_medias": {"event_id": "events"},
    "leaders": {"user_id": "users"},  # meant: its joins need it, the schema does not declare it
    "reservations": {"event_id": "events", "user_id": "users", "discount_code_id": "discount_codes"},
    "transactions": {"reservation_id": "reservations"},
    "discount_codes": {"event_id": "events", "creator_id": "users", "category_id": "event_categories",
                       "leader_id": "leaders"},
    "support_tickets": {"event_id": "events", "user_id": "users"},
    "support_ticket_messages": {"ticket_id": "support_tickets", "user_id": "users"},
    "notifications": {"event_id": "events", "reservation_id": "reservations", "pay_id": "transactions",
                      "ticket_id": "support_tickets", "user_id": "users"},
    "conversations": {"event_id": "events"},
    "conversation_participants": {"conversation_id": "conversations", "user_id": "users",
                                  "reservation_id": "reservations"},
    "messages": {"conversation_id": "conversations", "sender_id": "users", "reply_to": "messages"},
    "leader_followers": {"leader_id": "users", "follower_id": "users"},
    "ratings": {"from_user_id": "users", "to_user_id": "users", "conversation_id": "conversations"},
    "reports": {"reporter_id": "users", "reported_user_id": "users", "reported_conversation_id": "conversations",
                "reported_message_id": "messages", "reported_event_id": "events", "reported_leader_id": "leaders",
                "reported_memory_id": "memories"},
    "memories": {"user_id": "users", "event_id": "events", "thumbnail_id": "memory_medias"},
    "memory_medias": {"memory_id": "memories"},
    "memory_hashtags": {"memory_id": "memories"},
    "memory_likes": {"memory_id": "memories", "user_id": "users"},
    "memory_comments": {"memory_id": "memories", "user_id": "users"},
    "memories_saved": {"memory_id": "memories", "user_id": "users"},
}


SLOTS = 3  # foreign keys counted side by side with their owners


def marketplace_rules() -> list[Rule]:
    """All constraints that the schema declares: keys, foreign keys, NOT NULLs,
    ENUM domains and the score CHECK."""
    rules = []
    for t, required in REQUIRED.items():
        rules.append(Rule(t, "pk", ("id",)))
        rules += [Rule(t, "unique", cols) for cols in UNIQUES.get(t, ())]
        rules += [Rule(t, "not_null", (c,)) for c in ("id", *required.split())]
        rules += [Rule(t, "enum", (c,), values=v) for c, v in ENUMS.get(t, {}).items()]
        rules += [Rule(t, "range", (c,), values=v) for c, v in RANGES.get(t, {}).items()]
        rules += [Rule(t, "fk", (c,), ref=(r, "id")) for c, r in REFERENCES.get(t, {}).items()]
    return rules


def _key(df: DataFrame, cols) -> str:
    """A key as the SQL fields ``num`` (one whole number) and ``key`` (text; parts
    of several columns are joined by |); both are NULL if a part is NULL."""
    whole = [isinstance(df.schema[c].dataType, IntegralType) for c in cols]
    if len(cols) == 1:
        return (f"cast(`{cols[0]}` AS bigint) AS num, cast(null AS string) AS key" if whole[0]
                else f"cast(null AS bigint) AS num, cast(`{cols[0]}` AS string) AS key")
    parts = [f"cast(`{c}` AS string)" if w else rf"regexp_replace(cast(`{c}` AS string), r'([\\|])', r'\\$1')"
             for c, w in zip(cols, whole)]
    return f"cast(null AS bigint) AS num, {" || '|' || ".join(parts)} AS key"


def _broken(r: Rule) -> str:
    """The SQL condition of a row that breaks a column rule."""
    c = f"`{r.cols[0]}`"
    if r.kind == "not_null":
        return f"{c} IS NULL"
    if r.kind == "enum":
        values = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in r.values)
        return f"coalesce({c} NOT IN ({values}), false)"
    return f"coalesce({c} NOT BETWEEN {r.values[0]} AND {r.values[1]}, false)"


def audit(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """DQ-1: one row per rule: (table_name, rule, columns, violations, sample_key).

    ``violations`` counts keys that several rows own (pk, unique; a key with a
    NULL part is not compared), rows whose foreign key names no row, and rows
    that break a column rule; ``sample_key`` is the smallest offending key as
    text (of a column rule: the smallest id of an offending row). Both are NULL
    for a rule whose tables or columns are not among ``tables``: it was not audited.
    """
    def given(table, cols):
        return table in tables and set(cols) <= set(tables[table].columns)

    checked = [i for i, r in enumerate(rules) if given(r.table, r.cols)
               and (r.ref is None or given(r.ref[0], (r.ref[1],)))]
    spark = next(iter(tables.values())).sparkSession
    # Key spaces (column rules: spaces below 0), and the place of each rule's count in its space.
    spaces: dict[tuple, int] = {}
    place: dict[int, tuple[int, int]] = {}
    referred: dict[tuple, int] = {}
    for i in checked:
        r = rules[i]
        if r.kind in ("not_null", "enum", "range"):
            place[i] = (-1 - i, 0)
            continue
        owner, part, slot = (r.table, r.cols), 0, 0
        if r.kind == "fk":
            owner = (r.ref[0], (r.ref[1],))
            part, slot = divmod(referred.get(owner, 0), SLOTS)
            referred[owner], slot = referred.get(owner, 0) + 1, slot + 1
        place[i] = (spaces.setdefault((*owner, part), len(spaces)), slot)

    # Entries as SQL text: one expression per table, whatever the number of rules.
    entries = None
    for table in sorted({rules[i].table for i in checked} | {rules[i].ref[0] for i in checked if rules[i].ref}):
        df = tables[table]
        row = _key(df, ("id",) if "id" in df.columns else df.columns[:1])

        def entry(at, key):
            return f"struct({at[0]} AS space, {at[1]} AS slot, {key})"

        mine = [i for i in checked if rules[i].table == table]
        keys = [entry((s, 0), _key(df, cols)) for (t, cols, _), s in spaces.items() if t == table]
        keys += [entry(place[i], _key(df, rules[i].cols)) for i in mine if rules[i].kind == "fk"]
        broken = {i: _broken(rules[i]) for i in mine if place[i][0] < 0}
        own = f"array({', '.join(keys)})" if keys else "array()"
        if broken:  # entries for column rules only where a row breaks one
            wrong = ", ".join(f"if({b}, {entry(place[i], row)}, null)" for i, b in broken.items())
            own = f"if({' OR '.join(broken.values())}, concat({own}, array({wrong})), {own})"
        part = df.selectExpr(f"inline({own})").filter("num IS NOT NULL OR key IS NOT NULL OR space < 0")
        entries = part if entries is None else entries.unionAll(part)

    wide = entries.groupBy("space", "num", "key").agg(
        *[F.expr(f"count(*) FILTER (WHERE slot = {k}) AS n{k}") for k in range(SLOTS + 1)])
    # Only offending keys go on: broken column rules, keys owned twice, keys nobody owns.
    found = ", ".join(["if(space < 0, n0, if(n0 > 1, 1, 0))"] + [f"if(space >= 0 AND n0 = 0, n{k}, 0)"
                                                               for k in range(1, SLOTS + 1)])
    by_rule = (wide.filter("space < 0 OR n0 <> 1")
               .selectExpr("space", "coalesce(key, cast(num AS string)) AS key",
                           f"posexplode(array({found})) AS (slot, n)").filter("n > 0")
               .groupBy("space", "slot").agg(F.sum("n").alias("violations"), F.min("key").alias("sample_key")))
    # A count for each rule: bounded by the list of rules, so broadcast.
    names = spark.createDataFrame(
        [(r.table, r.kind, ",".join(r.cols), *place.get(i, (None, None))) for i, r in enumerate(rules)],
        "table_name string, rule string, columns string, space int, slot int")
    return names.join(F.broadcast(by_rule), ["space", "slot"], "left").select(
        "table_name", "rule", "columns",
        F.when(F.col("space").isNotNull(), F.coalesce("violations", F.lit(0))).alias("violations"), "sample_key")
