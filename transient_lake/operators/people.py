"""Collaboration queries over users, identities, teams, memberships, tags and
tag assignments (R1-R16, A9-A11, C15-C17, T5), set-at-a-time.

Visibility: a tag is visible to a user when the user owns it or is a member
of the owning team.  This is an OR across two keys, which a join would
evaluate as a nested loop, so it is written as the union of two equi-joins.
Every request-driven operator takes a *table* of requests (many users at
once) instead of one user id.  Per-user totals pre-aggregate tags per owner
before joining memberships, so one very large team never expands into
users x tags rows; where those rows are asked for, they are made in cells
of bounded size (``_team_tags``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import partitions
from .foreign_keys import delete_rows, orphans
from .numbering import dense_number, first_rows

#: Cells of a team's members x tags: about so many members of a slice and tags of a part, and at most so many members
#: whose ids travel as one row (504 is the most values that Parquet packs in one run, so repeats of a tile look alike).
SLICE, PART, TILE = 8_192, 4_096, 504


def _tag_owner(tags: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """Tags with owner_type / owner_id / owner_name (C17 inputs)."""
    t = (tags.join(teams.select(F.col("team_id").alias("owner_team_id"), F.col("name").alias("_team_name")),
                   "owner_team_id", "left")
         .join(users.select(F.col("user_id").alias("owner_user_id"), F.col("username").alias("_user_name")),
               "owner_user_id", "left"))
    is_team = F.col("owner_team_id").isNotNull()
    return t.select(*tags.columns, F.when(is_team, "team").otherwise("user").alias("owner_type"),
                    F.coalesce(F.col("owner_team_id").cast("long"), F.col("owner_user_id").cast("long")).alias("owner_id"),
                    F.when(is_team, F.col("_team_name")).otherwise(F.col("_user_name")).alias("owner_name"))


def visible_tags(requests: DataFrame, memberships: DataFrame, tags: DataFrame) -> DataFrame:
    """(request user_id) x visible tags - union of the personal and the
    team equi-joins."""
    r = requests.select("user_id").distinct()
    personal = r.join(tags, r.user_id == tags.owner_user_id).select("user_id", *[tags[c] for c in tags.columns])
    teams = r.join(memberships.select("user_id", "team_id"), "user_id")
    return personal.unionByName(_team_tags(teams, tags))


def _team_tags(members: DataFrame, tags: DataFrame) -> DataFrame:
    """Every tag of a team for every member row (user_id, team_id) of it.

    A join on the team alone would list a team's whole product in one task,
    member by member, and a file of it repeats the tags at a distance that
    grows with the team, past what Parquet can compress.  Members are dealt by
    hash into slices and tags into parts; each pair of them is a cell that a
    task of its own may list, so a task buffers one part of a team's tags.
    Member ids travel in tiles of at most ``TILE``, and each tag is listed for
    a tile at a time: a file holds runs of a tag and short repeats of ids."""
    n, cell = partitions(tags.sparkSession), ["_team", "_slice", "_part"]
    members = members.select("user_id", F.col("team_id").alias("_team"))
    size = lambda rows: F.ceil(F.count("*") / rows).cast("int")
    grid = members.groupBy("_team").agg(size(SLICE).alias("_slices")).join(
        tags.groupBy(F.col("owner_team_id").alias("_team")).agg(size(PART).alias("_parts")), "_team")
    within = Window.partitionBy("_team", "_slice").orderBy("user_id")
    tiles = (members.join(grid, "_team")
             .withColumn("_slice", F.pmod(F.xxhash64("user_id"), F.col("_slices")).cast("int"))
             .repartition(n, "_team", "_slice")
             .withColumn("_tile", F.floor((F.row_number().over(within) - 1) / TILE))
             .groupBy("_team", "_slice", "_tile", "_parts").agg(F.collect_list("user_id").alias("_users"))
             .select("_team", "_slice", "_users", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")))
    parts = (tags.join(grid, F.col("owner_team_id") == F.col("_team"))
             .withColumn("_part", F.pmod(F.xxhash64("tag_id"), F.col("_parts")).cast("int"))
             .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
             .drop("_slices", "_parts"))
    # a named number of partitions: AQE would join these by their bytes, which say nothing of the rows they make
    return (tiles.repartition(n, *cell).join(parts.repartition(n, *cell).hint("merge"), cell)
            .select(F.explode("_users").alias("user_id"), *tags.columns))


def visible_tag_counts(users: DataFrame, memberships: DataFrame, tags: DataFrame) -> DataFrame:
    """R1 totals per user without materialising (user, tag) pairs: tags are
    counted per owner first, then summed over each user's teams."""
    per_user = tags.where(F.col("owner_user_id").isNotNull()).groupBy(F.col("owner_user_id").alias("user_id")).agg(
        F.count("*").alias("n_personal"), F.min("name").alias("first_personal"))
    per_team = tags.where(F.col("owner_team_id").isNotNull()).groupBy(F.col("owner_team_id").alias("team_id")).agg(
        F.count("*").alias("_n"), F.min("name").alias("_first"))
    via_team = (memberships.select("user_id", "team_id").join(per_team, "team_id")
                .groupBy("user_id").agg(F.sum("_n").alias("n_team"), F.min("_first").alias("first_team")))
    out = users.select("user_id").join(per_user, "user_id", "left").join(via_team, "user_id", "left")
    return out.select(
        "user_id", F.coalesce("n_personal", F.lit(0)).alias("n_personal"),
        F.coalesce("n_team", F.lit(0)).cast("long").alias("n_team"),
        (F.coalesce("n_personal", F.lit(0)) + F.coalesce("n_team", F.lit(0))).cast("long").alias("n_visible"),
        F.least("first_personal", "first_team").alias("first_tag"))


def object_tags_for_user(requests: DataFrame, memberships: DataFrame, tags: DataFrame,
                         assignments: DataFrame) -> DataFrame:
    """R2: for (object_id, user_id) requests, the assignments on the object
    whose tag the user can see."""
    r = requests.select("object_id", "user_id").distinct()
    on_obj = r.join(assignments, "object_id")
    t = tags.select("tag_id", "name", "owner_user_id", "owner_team_id")
    personal = on_obj.join(t, "tag_id").where(F.col("owner_user_id") == F.col("user_id"))
    team = (on_obj.join(t.where(F.col("owner_team_id").isNotNull()), "tag_id")
            .join(memberships.select("user_id", F.col("team_id").alias("owner_team_id")), ["user_id", "owner_team_id"]))
    cols = ["object_id", "user_id", "tag_id", "name", "owner_user_id", "owner_team_id", "applied_by"]
    both = personal.select(*cols).unionByName(team.select(*cols))
    return both.withColumn("owner_type", F.when(F.col("owner_team_id").isNotNull(), "team").otherwise("user"))


def _visible_requests(requests: DataFrame, memberships: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, tag_id) requests kept only when the tag is visible."""
    r = requests.select("user_id", "tag_id").distinct()
    t = tags.select("tag_id", "owner_user_id", "owner_team_id")
    personal = r.join(t, "tag_id").where(F.col("owner_user_id") == F.col("user_id")).select("user_id", "tag_id")
    team = (r.join(t.where(F.col("owner_team_id").isNotNull()), "tag_id")
            .join(memberships.select("user_id", F.col("team_id").alias("owner_team_id")), ["user_id", "owner_team_id"])
            .select("user_id", "tag_id"))
    return personal.unionByName(team)


def tagged_objects(requests: DataFrame, memberships: DataFrame, tags: DataFrame, assignments: DataFrame) -> DataFrame:
    """Distinct objects carrying any requested tag the user can see
    (a user with no requested tags gets no rows)."""
    ok = _visible_requests(requests, memberships, tags)
    return ok.join(assignments.select("tag_id", "object_id"), "tag_id").select("user_id", "object_id").distinct()


def objects_for_tag(requests: DataFrame, memberships: DataFrame, tags: DataFrame, assignments: DataFrame,
                    limit: int = 100, offset: int = 0) -> DataFrame:
    """Per visible (user, tag) request, object ids in order, paged.

    Keyset paging: a request may carry a cursor ``after`` (the last object id
    of the page before; NULL for the first page).  Only ids beyond it are
    ranked, so page 1,000 costs what page 1 does; ``rank`` counts from the
    cursor.  With ``offset`` the rows before the page are ranked too, in hash
    slices (``first_rows``), never a whole tag in one task."""
    ok = _visible_requests(requests, memberships, tags)
    j = ok.join(assignments.select("tag_id", "object_id"), "tag_id")
    if "after" in requests.columns:
        at = requests.groupBy("user_id", "tag_id").agg(F.max("after").alias("_after"))
        j = j.join(at, ["user_id", "tag_id"]).where(F.col("_after").isNull() | (F.col("object_id") > F.col("_after"))).drop("_after")
    return first_rows(j, ["user_id", "tag_id"], ["object_id"], offset + limit).where(F.col("rank") > offset)


def user_teams(requests: DataFrame, memberships: DataFrame, teams: DataFrame) -> DataFrame:
    """Memberships of the requested users with team name/description."""
    m = requests.select("user_id").distinct().join(memberships, "user_id")
    return m.join(teams, "team_id", "left").select("user_id", "team_id", "role", "name", "description")


def team_members(requests: DataFrame, memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Member lists (with profile) of the requested teams.

    A team's list is returned once when at least one of its requesters is
    a member (so many requesters never multiply the list); each refused
    request (requester not a member) gets an error row instead."""
    r = requests.select("team_id", F.col("user_id").alias("requester_id")).distinct()
    mem_req = memberships.select("team_id", F.col("user_id").alias("requester_id"))
    allowed = r.join(mem_req, ["team_id", "requester_id"], "left_semi")
    denied = r.join(mem_req, ["team_id", "requester_id"], "left_anti").select(
        "team_id", "requester_id", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("username"), F.lit(None).cast("string").alias("email"),
        F.lit("not_a_member").alias("error"))
    teams_ok = allowed.select("team_id").distinct()
    members = (memberships.join(teams_ok, "team_id", "left_semi")
               .join(users.select("user_id", "username", "email"), "user_id", "left")
               .select("team_id", F.lit(None).cast("long").alias("requester_id"), F.col("user_id").cast("long"),
                       "role", "username", "email", F.lit(None).cast("string").alias("error")))
    return members.unionByName(denied)


def user_by_identity(requests: DataFrame, identities: DataFrame, users: DataFrame) -> DataFrame:
    """(provider, provider_user_id) -> user row (NULL when unknown)."""
    key = ["provider", "provider_user_id"]
    return requests.select(*key).join(identities.select(*key, "user_id"), key, "left").join(users, "user_id", "left")


def _contains_any(fields, q: str) -> Column:
    pattern = f"%{q.strip().lower()}%"
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(f), F.lit(""))).like(pattern) for f in fields])


USER_SEARCH_FIELDS = ("username", "nickname", "forename", "surname", "email")
SEARCH_LIMIT = 20


def search_users(users: DataFrame, q: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Case-insensitive contains over five fields (LIKE wildcards in
    ``q`` stay active), username ascending NULLs last then id; blank query
    returns nothing."""
    if not q.strip():
        return users.limit(0)
    return (users.where(_contains_any(USER_SEARCH_FIELDS, q))
            .orderBy(F.col("username").asc_nulls_last(), F.col("user_id")).limit(limit))


def search_teams(teams: DataFrame, memberships: DataFrame, q: str, user_id, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Teams by name/description with the user's ``is_member`` flag."""
    if not q.strip():
        return teams.limit(0).withColumn("is_member", F.lit(False))
    mine = memberships.where(F.col("user_id") == F.lit(user_id)).select("team_id", F.lit(True).alias("is_member"))
    hit = teams.where(_contains_any(("name", "description"), q)).orderBy("name", "team_id").limit(limit)
    return hit.join(mine, "team_id", "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))


def _empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


# Profile fields that a sign-in may fill, and what an identity keeps of its provider's profile.
PROFILE_FIELDS = ("username", "nickname", "email", "institution", "forename", "surname", "picture_url", "bio")
PROVIDER_FIELDS = {"provider_username": "username", "provider_email": "email",
                   "provider_profile_json": "provider_profile_json"}


def merge_identities(users: DataFrame, identities: DataFrame, incoming: DataFrame,
                     profile_fields=PROFILE_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Bulk sign-in merge.  ``incoming``: provider, provider_user_id and
    profile fields.  Known identities fill only the user's empty fields and
    refresh what the identity keeps of the provider's profile; unknown
    identities create a user (id = max id + rank) and an identity.

    Fields merge one by one: of several sign-ins of one identity the smallest
    non-empty value counts, of several identities of one user the first
    non-empty value by (provider, provider_user_id).  Fields absent from
    ``users`` or ``incoming`` are left alone."""
    key = ["provider", "provider_user_id"]
    fields = [f for f in profile_fields if f in users.columns and f in incoming.columns]
    carried = [c for c in incoming.columns if c not in key]
    inc = incoming.groupBy(*key).agg(*[F.min(F.when(~_empty(F.col(c)), F.col(c))).alias(c) for c in carried])
    known = inc.join(identities.select(*key, "user_id"), key)
    upd = known.groupBy("user_id").agg(*[
        F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(*key))).alias(f"_in_{f}") for f in fields])
    u = users.join(upd, "user_id", "left").select(
        *[F.when(_empty(F.col(f)), F.coalesce(F.col(f"_in_{f}"), F.col(f))).otherwise(F.col(f)).alias(f) if f in fields
          else F.col(f) for f in users.columns])
    new = inc.join(identities.select(*key), key, "left_anti")
    top = users.agg(F.coalesce(F.max("user_id"), F.lit(0)).alias("_top"))  # one row
    new = (dense_number(new, [], key, "_k").join(F.broadcast(top), F.lit(True))
           .withColumn("user_id", F.col("_top") + F.col("_k")).drop("_k", "_top"))
    new_users = new.select("user_id", *[F.col(f) if f in new.columns else F.lit(None).cast(users.schema[f].dataType).alias(f)
                                        for f in users.columns if f != "user_id"])
    users_out = u.unionByName(new_users.select(*users.columns))
    kept = {c: p for c, p in PROVIDER_FIELDS.items() if c in identities.columns and p in inc.columns}
    seen = inc.select(*key, F.lit(True).alias("_seen"), *[F.col(p).alias(f"_p_{c}") for c, p in kept.items()])
    refreshed = identities.join(seen, key, "left").select(
        *[F.when(F.col("_seen"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c)
          for c in identities.columns])
    created = new.select(*[F.col(kept[c]).alias(c) if c in kept else F.col(c) if c in new.columns
                           else F.lit(None).cast(identities.schema[c].dataType).alias(c) for c in identities.columns])
    return users_out, refreshed.unionByName(created)


def apply_team_updates(teams: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial team updates; only supplied fields change (``set_<f>``
    flags), a supplied name is trimmed and must not be blank.  An update with a
    blank name is refused as a whole; of several good ones of a team a field
    takes the smallest value set (one row a team, as in profile updates)."""
    fields = ["name", "description"]
    u = updates.select("team_id", *fields, *[f"set_{f}" for f in fields])
    blank = F.col("set_name") & (F.col("name").isNull() | (F.trim("name") == ""))
    bad = u.where(blank).select("team_id").distinct()
    good = (u.where(~F.coalesce(blank, F.lit(False))).withColumn("name", F.trim("name")).groupBy("team_id")
            .agg(*[F.min(F.when(F.col(f"set_{f}"), F.col(f))).alias(f"_n_{f}") for f in fields],
                 *[F.bool_or(f"set_{f}").alias(f"_s_{f}") for f in fields]))
    j = teams.join(good, "team_id", "left")
    out = j.select(*[F.when(F.col(f"_s_{c}") == True, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)  # noqa: E712
                     if c in fields else F.col(c) for c in teams.columns])
    return out, bad.withColumn("error", F.lit("Team name must not be blank."))


def owner_counts(memberships: DataFrame) -> DataFrame:
    """Owners per team."""
    return memberships.groupBy("team_id").agg(F.expr("count_if(role = 'owner')").alias("n_owners"),
                                              F.count("*").alias("n_members"))


def leave_team_check(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """A sole owner may not leave; a non-member cannot leave."""
    r = requests.select("team_id", "user_id").distinct()
    j = r.join(memberships, ["team_id", "user_id"], "left").join(owner_counts(memberships), "team_id", "left")
    reason = (F.when(F.col("role").isNull(), "not a member")
              .when((F.col("role") == "owner") & (F.col("n_owners") <= 1), "sole owner"))
    return j.select("team_id", "user_id", "role", reason.isNull().alias("allowed"), reason.alias("reason"))


# Which roles may perform which team action.
ACTION_ROLES = {
    "delete_team": ["owner"],
    "update_team": ["owner"],
    "manage_members": ["owner", "admin"],
    "view_members": ["owner", "admin", "member"],
    "use_team_tags": ["owner", "admin", "member"],
}


def permission_check(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, team_id, action) -> allowed + reason, by role."""
    roles = requests.sparkSession.createDataFrame(
        [(a, r) for a, rs in ACTION_ROLES.items() for r in rs], "action string, role string")
    j = requests.join(memberships, ["team_id", "user_id"], "left")
    ok = j.join(F.broadcast(roles).withColumn("_ok", F.lit(True)), ["action", "role"], "left")
    known = F.col("action").isin(list(ACTION_ROLES))
    reason = (F.when(~known, "unknown action").when(F.col("role").isNull(), "not a member")
              .when(F.col("_ok").isNull(), F.concat(F.lit("role "), F.col("role"), F.lit(" may not "), F.col("action"))))
    return ok.select("user_id", "team_id", "action", "role", reason.isNull().alias("allowed"), reason.alias("reason"))


# What may be done with a tag by its owner, or by any member of the team that owns it.
TAG_ACTIONS = ("view_tag", "assign_tag", "remove_assignment")


def tag_permission_check(requests: DataFrame, tags: DataFrame, memberships: DataFrame) -> DataFrame:
    """R15 for tags: (user_id, tag_id, action) -> allowed + reason.  A personal
    tag is its owner's alone, a team's tag is for all its members; a tag that
    is not visible to the user is unknown to them."""
    owned = requests.join(tags.select("tag_id", "owner_user_id", "owner_team_id"), "tag_id", "left")
    mine = memberships.select(F.col("user_id").alias("user_id"), F.col("team_id").alias("owner_team_id"), "role")
    j = owned.join(mine, ["user_id", "owner_team_id"], "left")
    own = F.coalesce(F.col("owner_user_id") == F.col("user_id"), F.lit(False))
    reason = (F.when(~F.col("action").isin(list(TAG_ACTIONS)), "unknown action")
              .when(F.col("owner_user_id").isNull() & F.col("owner_team_id").isNull(), "unknown tag")
              .when(~own & F.col("role").isNull(), "no permission for this tag"))
    return j.select("user_id", "tag_id", "action", reason.isNull().alias("allowed"), reason.alias("reason"))


def resolve_tag(requests: DataFrame, memberships: DataFrame, tags: DataFrame) -> DataFrame:
    """(request_id, user_id, tag_id | tag_name [+ owner_team_id]) ->
    the visible tag, else a 'unknown_tag' error."""
    t = tags.select("tag_id", "name", "owner_user_id", "owner_team_id")

    def first_tag(key: list[str]) -> DataFrame:
        # of the tags that a request can mean the first counts: one row a key meets the requests, not all of them
        rest = [c for c in t.columns if c not in key]
        return (t.na.drop(subset=key).groupBy(*key).agg(F.min(F.struct("tag_id", *[c for c in rest if c != "tag_id"])).alias("_t"))
                .select(*key, *[F.col(f"_t.{c}").alias(c) for c in rest]))

    by_id = requests.where(F.col("tag_id").isNotNull()).select("request_id", "user_id", "tag_id").join(t, "tag_id")
    by_team = (requests.where(F.col("tag_id").isNull() & F.col("owner_team_id").isNotNull())
               .select("request_id", "user_id", F.col("tag_name").alias("name"), "owner_team_id")
               .join(first_tag(["name", "owner_team_id"]), ["name", "owner_team_id"]))
    by_self = (requests.where(F.col("tag_id").isNull() & F.col("owner_team_id").isNull())
               .select("request_id", "user_id", F.col("tag_name").alias("name"), F.col("user_id").alias("owner_user_id"))
               .join(first_tag(["name", "owner_user_id"]), ["name", "owner_user_id"]))
    cols = ["request_id", "user_id", "tag_id", "name", "owner_user_id", "owner_team_id"]
    cand = by_id.select(*cols).unionByName(by_team.select(*cols)).unionByName(by_self.select(*cols))
    first = cand.groupBy("request_id", "user_id").agg(F.min_by(F.struct(*cols[2:]), "tag_id").alias("t")).select(
        "request_id", "user_id", "t.*")
    mine = memberships.select("user_id", F.col("team_id").alias("owner_team_id"), F.lit(True).alias("_m"))
    vis = first.join(mine, ["user_id", "owner_team_id"], "left").where(
        (F.col("owner_user_id") == F.col("user_id")) | F.col("_m").isNotNull()).drop("_m")
    missing = requests.select("request_id", "user_id").join(vis.select("request_id"), "request_id", "left_anti")
    return vis.withColumn("error", F.lit(None).cast("string")).unionByName(
        missing.select("request_id", "user_id", *[F.lit(None).cast(vis.schema[c].dataType).alias(c) for c in cols[2:]],
                       F.lit("unknown_tag").alias("error")))


def insert_memberships(memberships: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add (team_id, user_id, role) rows; existing members are
    rejected, not overwritten."""
    key = ["team_id", "user_id"]
    req = requests.groupBy(*key).agg(F.min("role").alias("role"))  # of differing roles the first by name
    existing = req.join(memberships.select(*key), key, "left_semi")
    new = req.join(memberships.select(*key), key, "left_anti")
    return memberships.unionByName(new.select(*memberships.columns)), existing.select(
        *key, F.lit("already a member").alias("error"))


def create_teams(teams: DataFrame, memberships: DataFrame, new_teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New teams (team_id, name, description, creator_id) are added and
    their creator becomes the owner."""
    t = new_teams.join(teams.select("team_id"), "team_id", "left_anti")
    return (teams.unionByName(t.select(*teams.columns)),
            memberships.unionByName(t.select("team_id", F.col("creator_id").alias("user_id"), F.lit("owner").alias("role"))
                                    .select(*memberships.columns)))


def cascade_delete(tables: dict[str, DataFrame], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables (users, identities, teams, memberships, tags,
    assignments; as many as are given) after a deletion and all that follows
    from it by the declared foreign keys."""
    return delete_rows(tables, deleted)


def cascade_delete_teams(deleted: DataFrame, teams, memberships, tags, assignments):
    """Removing teams removes their memberships, their tags and those
    tags' assignments."""
    left = delete_rows({"teams": teams, "memberships": memberships, "tags": tags, "assignments": assignments}, {"teams": deleted})
    return left["teams"], left["memberships"], left["tags"], left["assignments"]


def cascade_delete_users(deleted: DataFrame, users, memberships, tags, assignments):
    """Removing users removes their memberships and personal tags (and
    those tags' assignments); ``applied_by`` of surviving assignments that
    points at a removed user becomes NULL.  ``cascade_delete`` takes identities
    and teams along."""
    left = delete_rows({"users": users, "memberships": memberships, "tags": tags, "assignments": assignments}, {"users": deleted})
    return left["users"], left["memberships"], left["tags"], left["assignments"]


def remove_assignments(requests: DataFrame, assignments: DataFrame, tags: DataFrame,
                       memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R15 + R14: (object_id, tag_id, user_id) requests to take a tag off an
    object.  The owner of a personal tag and every member of the owning team
    may; one allowed request is enough.  Returns the assignments that are left
    and the requests with ``removed`` and ``reason``."""
    key = ["object_id", "tag_id"]
    r = requests.select(*key, "user_id").distinct()
    found = r.join(assignments.select(*key, F.lit(True).alias("_found")), key, "left")
    allowed = tag_permission_check(r.select("user_id", "tag_id").distinct().withColumn("action", F.lit("remove_assignment")),
                                   tags, memberships).select("user_id", "tag_id", "allowed", "reason")
    judged = found.join(allowed, ["user_id", "tag_id"]).withColumn(
        "reason", F.when(F.col("_found").isNull(), "no such assignment").otherwise(F.col("reason"))).select(
        *key, "user_id", F.col("reason").isNull().alias("removed"), "reason")
    return assignments.join(judged.where("removed").select(*key).distinct(), key, "left_anti"), judged


def audit_constraints(users, identities, teams, memberships, tags, assignments) -> DataFrame:
    """One frame of constraint violations (kind, key, n): broken unique
    keys and owners, and rows whose parent is missing by the declared keys."""
    def dup(df, kind, cols):
        return (df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")
                .select(F.lit(kind).alias("kind"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"), "n"))
    parts = [
        dup(users.where(F.col("username").isNotNull()), "duplicate username", ["username"]),
        dup(teams, "duplicate team name", ["name"]),
        dup(identities, "duplicate identity", ["provider", "provider_user_id"]),
        dup(tags.where(F.col("owner_user_id").isNotNull()), "duplicate personal tag name", ["owner_user_id", "name"]),
        dup(tags.where(F.col("owner_team_id").isNotNull()), "duplicate team tag name", ["owner_team_id", "name"]),
        dup(assignments, "duplicate assignment", ["object_id", "tag_id"]),
        tags.where(F.col("owner_user_id").isNull() == F.col("owner_team_id").isNull()).select(
            F.lit("tag owner not exactly one").alias("kind"), F.col("tag_id").cast("string").alias("key"),
            F.lit(1).cast("long").alias("n")),
        orphans({"users": users, "identities": identities, "teams": teams, "memberships": memberships, "tags": tags,
                 "assignments": assignments}),
        owner_counts(memberships).where("n_owners = 0").select(
            F.lit("team without owner").alias("kind"), F.col("team_id").cast("string").alias("key"),
            F.lit(1).cast("long").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- C15-C17, A10 ----------------------------------------------------------

def display_label(username="username", forename="forename", surname="surname", email="email",
                  placeholder: str = "Unnamed user") -> Column:
    """Username, else full name, else email, else a placeholder."""
    full = F.trim(F.concat_ws(" ", F.col(forename), F.col(surname)))
    return F.coalesce(F.nullif(F.trim(F.col(username)), F.lit("")), F.nullif(full, F.lit("")),
                      F.nullif(F.trim(F.col(email)), F.lit("")), F.lit(placeholder))


def username_base(text, default: str = "user") -> Column:
    """Lower-case, keep [a-z0-9], default when nothing is left."""
    base = F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), "[^a-z0-9]", "")
    return F.coalesce(F.nullif(base, F.lit("")), F.lit(default))


def username_suffix(user_id) -> Column:
    """Deterministic 3-4 digit suffix from the id (100-9999)."""
    return (F.pmod(F.xxhash64(F.col(user_id).cast("string")), F.lit(9900)) + 100).cast("string")


def tag_option_label(tags_with_owner: DataFrame) -> Column:
    """C17: ``name (team: x)`` or ``name (personal)``."""
    return F.when(F.col("owner_type") == "team",
                  F.concat(F.col("name"), F.lit(" (team: "), F.coalesce("owner_name", F.lit("")), F.lit(")"))
                  ).otherwise(F.concat(F.col("name"), F.lit(" (personal)")))


def tags_grouped_by_owner(tags_with_owner: DataFrame) -> DataFrame:
    """A10: one section per owner: personal sections first, then teams by
    lower-case team name.  Sections carry counts and the first/last tag
    name (partial aggregates); the names themselves are listed by paging
    the tags table, never gathered into one row."""
    g = tags_with_owner.groupBy("owner_type", "owner_id", "owner_name").agg(
        F.count("*").alias("n_tags"), F.min("name").alias("first_tag"), F.max("name").alias("last_tag"))
    return g.withColumn("section_order", F.when(F.col("owner_type") == "user", 0).otherwise(1)).withColumn(
        "sort_name", F.lower("owner_name"))


def tag_rows_by_owner(tags_with_owner: DataFrame) -> DataFrame:
    """A10 as rows: every tag with its section (personal sections first, then
    teams by lower-case name) and the columns that order it there.  A range
    sort by these columns lists any number of tags of one owner."""
    return tags_with_owner.select(
        F.when(F.col("owner_type") == "user", 0).otherwise(1).alias("section_order"),
        F.lower("owner_name").alias("sort_name"), "owner_type", "owner_id", "owner_name",
        F.lower("name").alias("tag_order"), "tag_id", "name")


def visible_tag_rows(requests: DataFrame, memberships: DataFrame, tags: DataFrame, users: DataFrame,
                     teams: DataFrame) -> DataFrame:
    """R1 as rows: each requested user's visible tags with owner type and
    name, and the lower-case tag name that orders them."""
    owned = _tag_owner(tags, users, teams).withColumn("tag_order", F.lower("name"))
    return visible_tags(requests, memberships, owned).select(
        "user_id", "tag_order", "tag_id", "name", "owner_type", "owner_id", "owner_name")


def apply_profile_updates(users: DataFrame, updates: DataFrame,
                          fields=("nickname", "forename", "surname", "email")) -> DataFrame:
    """Partial profile updates: a field changes only when its
    ``set_<field>`` flag is true (so a field can be set to NULL)."""
    # of several updates of a user, a field that one of them sets takes the smallest set value
    u = updates.groupBy("user_id").agg(*[F.min(F.when(F.col(f"set_{f}"), F.col(f))).alias(f"_n_{f}") for f in fields],
                                       *[F.bool_or(f"set_{f}").alias(f"_s_{f}") for f in fields])
    j = users.join(u, "user_id", "left")
    return j.select(*[F.when(F.col(f"_s_{c}") == True, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)  # noqa: E712
                      if c in fields else F.col(c) for c in users.columns])


def insert_assignments(assignments: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tag an object idempotently - an existing (object, tag) pair is
    rejected, not overwritten; new pairs are appended."""
    key = ["object_id", "tag_id"]
    req = requests.groupBy(*key).agg(F.min("applied_by").alias("applied_by"))
    new = req.join(assignments.select(*key), key, "left_anti")
    rejected = req.join(assignments.select(*key), key, "left_semi").withColumn("error", F.lit("already tagged"))
    return assignments.unionByName(new.select(*assignments.columns)), rejected
