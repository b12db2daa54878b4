"""Collation invariants and collaboration goldens."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from transient_lake.operators import hits as H
from transient_lake.operators import people as P
from transient_lake.operators import retention as R
from transient_lake.operators.components import LAST_RUN, star_components
from transient_lake.sources import testdata as td

from .conftest import SF_SMALL

PAIR = ("obj_id_1 string, source_1 string, ra_deg_1 double, dec_deg_1 double, timestamp_1 timestamp, "
        "obj_id_2 string, source_2 string, ra_deg_2 double, dec_deg_2 double, timestamp_2 timestamp")
T0 = dt.datetime(2024, 1, 1)


def _pairs(spark, edges):
    rows = [(a, "ztf", 1.0, 1.0, T0, b, "lsst", 1.0, 1.0, T0) for a, b in edges]
    return spark.createDataFrame(rows, PAIR)


def _components(members):
    comp = {}
    for r in members.collect():
        comp.setdefault(r.xmatch_id, set()).add(r.obj_id)
    return {frozenset(v) for v in comp.values()}


def test_components_are_order_independent_and_complete(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q"), ("q", "r"), ("r", "p")]
    shuffled = edges[:]
    random.Random(1).shuffle(shuffled)
    m1, hits, rej = H.collate_hits(_pairs(spark, edges))
    m2, _, _ = H.collate_hits(_pairs(spark, shuffled))
    want = {frozenset("abcd"), frozenset("xy"), frozenset("pqr")}
    assert _components(m1) == want == _components(m2)
    # the smallest member id names the hit
    assert {r.xmatch_id for r in hits.collect()} == {"a", "x", "p"}
    assert rej.count() == 0


def test_duplicate_pairs_are_rejected(spark):
    _, hits, rej = H.collate_hits(_pairs(spark, [("a", "b"), ("a", "b"), ("b", "c")]))
    assert [(r.obj_id_1, r.obj_id_2, r.n_submitted) for r in rej.collect()] == [("a", "b", 2)]
    assert hits.collect()[0].n_pairs == 2


def test_long_chain_settles(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    m, _, _ = H.collate_hits(_pairs(spark, edges))
    assert _components(m) == {frozenset(f"n{i:03d}" for i in range(41))}


@pytest.mark.parametrize("order", ["random", "zigzag"])
def test_chains_settle_in_any_id_order(spark, order):
    n = 5000
    ids = list(range(n))
    if order == "random":
        random.Random(4).shuffle(ids)
    else:  # 0, n - 1, 1, n - 2, ...
        ids = [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    out = star_components(edges)
    assert out.count() == n and out.select("label").distinct().collect() == [(0,)]
    assert LAST_RUN["rounds"] <= 20


def test_components_of_a_hub_and_self_links(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(9000, 9000), (None, 1), (9001, 9002)], "src long, dst long")
    out = {r.node: r.label for r in star_components(edges).collect()}
    assert out[9000] == 9000 and out[9002] == 9001 and {out[i] for i in range(3000)} == {0} and len(out) == 3003


def test_incremental_update_merges_hits(spark):
    members, _, _ = H.collate_hits(_pairs(spark, [("a", "b"), ("c", "d")]))
    changed, merges = H.update_hits(members, _pairs(spark, [("b", "c"), ("e", "f")]))
    assert _components(changed) == {frozenset("abcd"), frozenset("ef")}
    assert [(r.xmatch_id, r.merged_from) for r in merges.collect()] == [("a", ["a", "c"])]


def test_a_published_hit_keeps_its_id(spark):
    members, _, _ = H.collate_hits(_pairs(spark, [("m", "n")]))
    changed, _ = H.update_hits(members, _pairs(spark, [("a", "m")]))
    assert {(r.obj_id, r.xmatch_id) for r in changed.collect()} == {("a", "m"), ("m", "m"), ("n", "m")}


def test_two_providers_fill_one_user(spark):
    users = spark.createDataFrame([(1, "u", None, "", None)], "user_id long, username string, forename string, surname string, email string")
    idents = spark.createDataFrame([("github", "g", 1, "old", None), ("orcid", "o", 1, None, None)],
                                   "provider string, provider_user_id string, user_id long, provider_username string, provider_email string")
    inc = spark.createDataFrame([("github", "g", "x", "Ann", None, None), ("orcid", "o", "y", None, "Lee", "a@x"), ("orcid", "o", "y", "Zoe", None, None),
                                 ("orcid", "new", "z", "Bo", None, "b@x")],
                                "provider string, provider_user_id string, username string, forename string, surname string, email string")
    u, i = P.merge_identities(users, idents, inc)
    assert {tuple(r) for r in u.collect()} == {(1, "u", "Ann", "Lee", "a@x"), (2, "z", "Bo", None, "b@x")}
    assert {(r.provider_user_id, r.provider_username, r.provider_email) for r in i.collect()} == {
        ("g", "x", None), ("o", "y", "a@x"), ("new", "z", "b@x")}


def test_year_out_of_numbers_gets_no_id(spark):
    from transient_lake.operators import catalogue as cat
    reg = spark.createDataFrame([(2024, 36 ** 6 - 2, "TXV-2024-X", "s0")], "year int, idx long, archive_id string, source_id string")
    new = spark.createDataFrame([("s1", 2024), ("s2", 2024), ("s0", 2024)], "source_id string, year int")
    out = {r.source_id: r for r in cat.assign_ids(new, reg).collect()}
    assert sorted((out["s1"].overflow, out["s2"].overflow)) == [False, True]
    assert all((r.archive_id is None) == r.overflow for r in out.values()) and out["s0"].archive_id == "TXV-2024-X"


def test_ids_do_not_follow_the_shuffle_width(spark):
    from transient_lake.operators.numbering import dense_number
    df = spark.range(3000).selectExpr("id % 3 as g", "id")
    seen = []
    for width in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        seen.append(sorted(map(tuple, dense_number(df, ["g"], ["id"]).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and {r[2] for r in seen[0]} == set(range(1, 1001))


def _collab(spark):
    users = spark.createDataFrame([(1, "owner", None, None, None, "o@x"), (2, "mate", None, None, None, "m@x"),
                                   (3, "outsider", None, None, None, "z@x"), (4, "joiner_b", None, "Jo", None, None)],
                                  "user_id long, username string, nickname string, forename string, surname string, "
                                  "email string")
    teams = spark.createDataFrame([(10, "spectroscopy", "spectro team"), (11, "photometry", None)],
                                  "team_id long, name string, description string")
    mem = spark.createDataFrame([(10, 1, "owner"), (10, 2, "member"), (11, 3, "owner")],
                                "team_id long, user_id long, role string")
    tags = spark.createDataFrame([(100, "interesting", 1, None), (101, "follow-up", None, 10)],
                                 "tag_id long, name string, owner_user_id long, owner_team_id long")
    asg = spark.createDataFrame([("2024abc", 100, 1), ("2024abc", 101, 2), ("2024xyz", 101, 1)],
                                "object_id string, tag_id long, applied_by long")
    return users, teams, mem, tags, asg


def test_visibility_owner_teammate_outsider(spark):
    users, teams, mem, tags, asg = _collab(spark)
    req = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    vis = {}
    for r in P.visible_tags(req, mem, tags).collect():
        vis.setdefault(r.user_id, set()).add(r.name)
    assert vis == {1: {"interesting", "follow-up"}, 2: {"follow-up"}}
    counts = {r.user_id: r.n_visible for r in P.visible_tag_counts(users, mem, tags).collect()}
    assert counts == {1: 2, 2: 1, 3: 0, 4: 0}
    treq = spark.createDataFrame([(1, 100), (1, 101), (2, 100), (2, 101), (3, 101)], "user_id long, tag_id long")
    objs = {(r.user_id, r.object_id) for r in P.tagged_objects(treq, mem, tags, asg).collect()}
    assert objs == {(1, "2024abc"), (1, "2024xyz"), (2, "2024abc"), (2, "2024xyz")}


def test_search_users_and_teams(spark):
    users, teams, mem, tags, asg = _collab(spark)
    assert [r.username for r in P.search_users(users, "  JOINER ").collect()] == ["joiner_b"]
    assert P.search_users(users, "   ").count() == 0
    got = {(r.name, r.is_member) for r in P.search_teams(teams, mem, "spectro", 2).collect()}
    assert got == {("spectroscopy", True)}
    got = {(r.name, r.is_member) for r in P.search_teams(teams, mem, "spectro", 3).collect()}
    assert got == {("spectroscopy", False)}


def test_audit_finds_duplicate_username(spark):
    users, teams, mem, tags, asg = _collab(spark)
    dup = users.unionByName(users.where("user_id = 2").withColumn("user_id", F.lit(9).cast("long")))
    ids = spark.createDataFrame([], "provider string, provider_user_id string, user_id long")
    v = P.audit_constraints(dup, ids, teams, mem, tags, asg).collect()
    assert ("duplicate username", "mate") in {(r.kind, r.key) for r in v}


def _gfs_reference(dates, today):
    """Day-by-day statement of the rotation rule, newest first."""
    keep, last_week, last_month = set(), None, None
    for d in sorted(dates, reverse=True):
        age = (today - d).days
        if age <= 7:
            keep.add(d)
        elif age <= 90:
            if d.toordinal() // 7 != last_week:
                keep.add(d)
                last_week = d.toordinal() // 7
        elif age <= 365:
            if d.year * 12 + d.month != last_month:
                keep.add(d)
                last_month = d.year * 12 + d.month
    return keep


def test_retention_matches_day_by_day_rule(spark):
    today = dt.date(2025, 3, 15)
    dates = [today - dt.timedelta(days=i) for i in range(0, 500, 1)]
    paths = spark.createDataFrame([(f"/b/db-{d:%Y%m%d}-010203.json",) for d in dates] + [("/b/notes.txt",)], "path string")
    out = R.snapshot_retention(R.snapshot_table(paths), today.isoformat()).where("keep").collect()
    assert {r.snapshot_date for r in out} == _gfs_reference(dates, today)


def test_document_and_long_forms_agree(spark):
    from transient_lake.operators import search as S
    from transient_lake.plans.search_queries import CONDITIONS, SEARCH, SEARCH_IN_LIKE
    from transient_lake.sources import testdata as td

    from .conftest import SF_SMALL
    docs, rows = td.legacy_objects(spark, SF_SMALL), td.legacy_rows(spark, SF_SMALL)
    for q in (SEARCH, SEARCH_IN_LIKE, {}):
        a = {r.obj_id for r in S.search_objects(docs, q).collect()}
        b = {r.obj_id for r in S.search_objects_long(rows, q).collect()}
        assert a == b
    a = {r.obj_id for r in S.match_alert_conditions(td.alert_docs(spark, SF_SMALL), CONDITIONS).collect()}
    b = {r.obj_id for r in S.match_alert_conditions_long(td.alert_rows(spark, SF_SMALL), CONDITIONS).collect()}
    assert a == b


def test_search_rejects_bad_requests(spark):
    import pytest as _pytest

    from transient_lake.operators import search as S
    for bad in ({"mags": [{"value": 1, "operator": "!="}]}, {"mags": [{"colour": 1, "operator": "<"}]},
                {"mags": [{"value": "1; drop", "operator": "="}]}, {"mags": [{"value": {"a": 1}, "operator": "="}]}):
        with _pytest.raises(ValueError):
            S.search_condition(bad)


def test_membership_inserts_and_team_creation(spark):
    users, teams, mem, tags, asg = _collab(spark)
    req = spark.createDataFrame([(10, 2, "member"), (11, 2, "member")], "team_id long, user_id long, role string")
    mem2, rejected = P.insert_memberships(mem, req)
    assert [(r.team_id, r.user_id) for r in rejected.collect()] == [(10, 2)]
    assert mem2.where("team_id = 11 and user_id = 2").count() == 1 and mem2.count() == 4
    new = spark.createDataFrame([(12, "lensing", None, 4)], "team_id long, name string, description string, creator_id long")
    t2, m2 = P.create_teams(teams, mem, new)
    assert t2.count() == 3 and [r.role for r in m2.where("team_id = 12").collect()] == ["owner"]


def test_user_cascade_and_applied_by(spark):
    users, teams, mem, tags, asg = _collab(spark)
    gone = spark.createDataFrame([(1,)], "user_id long")
    u2, m2, t2, a2 = P.cascade_delete_users(gone, users, mem, tags, asg)
    assert 1 not in {r.user_id for r in u2.collect()} and m2.where("user_id = 1").count() == 0
    assert {r.tag_id for r in t2.collect()} == {101}
    # the personal tag's assignment is gone; the team tag's assignment applied by user 1 keeps a NULL author
    assert {(r.object_id, r.tag_id, r.applied_by) for r in a2.collect()} == {("2024abc", 101, 2), ("2024xyz", 101, None)}


def test_permissions_and_sole_owner(spark):
    users, teams, mem, tags, asg = _collab(spark)
    mem = mem.unionByName(spark.createDataFrame([(10, 4, "admin")], "team_id long, user_id long, role string"))
    req = spark.createDataFrame([(4, 10, "manage_members"), (2, 10, "delete_team"), (3, 10, "view_members"),
                                 (1, 10, "rename_everything")], "user_id long, team_id long, action string")
    got = {(r.user_id, r.action): (r.allowed, r.reason) for r in P.permission_check(req, mem).collect()}
    assert got[(4, "manage_members")] == (True, None)
    assert got[(2, "delete_team")] == (False, "role member may not delete_team")
    assert got[(3, "view_members")] == (False, "not a member")
    assert got[(1, "rename_everything")] == (False, "unknown action")
    leave = spark.createDataFrame([(10, 1), (10, 2)], "team_id long, user_id long")
    res = {r.user_id: (r.allowed, r.reason) for r in P.leave_team_check(leave, mem).collect()}
    assert res == {1: (False, "sole owner"), 2: (True, None)}


def test_resolve_tag_requires_visibility(spark):
    users, teams, mem, tags, asg = _collab(spark)
    req = spark.createDataFrame([(1, 2, None, "follow-up", 10), (2, 3, None, "follow-up", 10), (3, 1, None, "interesting", None),
                                 (4, 2, 100, None, None)],
                                "request_id long, user_id long, tag_id long, tag_name string, owner_team_id long")
    got = {r.request_id: (r.tag_id, r.error) for r in P.resolve_tag(req, mem, tags).collect()}
    assert got == {1: (101, None), 2: (None, "unknown_tag"), 3: (100, None), 4: (None, "unknown_tag")}


def test_bad_dates_are_skipped_not_fatal(spark):
    from transient_lake.operators import search as S
    paths = spark.createDataFrame([("/b/db-20240231-010203.json",), ("/b/db-20240228-010203.json",)], "path string")
    snaps = R.snapshot_table(paths).collect()
    assert [str(r.snapshot_date) for r in snaps] == ["2024-02-28"]
    rows = spark.createDataFrame([(1, "discovery_date", "tns", "unknown", None, None),
                                  (2, "discovery_date", "tns", "2024-03-01", None, None)],
                                 "obj_id long, field string, source string, value string, filter string, mag_rate double")
    cond = {"discovery_date": [{"source": "tns", "date_limit": "2024-01-10", "operator": ">"}]}
    assert [r.obj_id for r in S.match_alert_conditions_long(rows, cond).collect()] == [2]


def test_a_deletion_takes_everything_that_hangs_on_it(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, username string")
    identities = spark.createDataFrame([("orcid", "x", 1), ("orcid", "y", 2)], "provider string, provider_user_id string, user_id long")
    teams = spark.createDataFrame([(10, "t", 1), (11, "u", 2)], "team_id long, name string, created_by long")
    mem = spark.createDataFrame([(10, 1, "owner"), (10, 2, "member")], "team_id long, user_id long, role string")
    tags = spark.createDataFrame([(100, "p", 1, None), (101, "q", None, 10), (102, "r", 2, None)],
                                 "tag_id long, name string, owner_user_id long, owner_team_id long")
    asg = spark.createDataFrame([("o1", 100, 2), ("o1", 101, 1), ("o2", 102, 1), ("o3", 102, None)], "object_id string, tag_id long, applied_by long")
    tables = {"users": users, "identities": identities, "teams": teams, "memberships": mem, "tags": tags, "assignments": asg}
    rows = lambda left: {n: sorted(map(tuple, df.collect()), key=str) for n, df in left.items()}
    gone = spark.createDataFrame([(1,), (1,), (77,)], "user_id long")
    assert rows(P.cascade_delete(tables, {"users": gone})) == {
        "users": [(2, "b")], "identities": [("orcid", "y", 2)], "teams": sorted([(10, "t", None), (11, "u", 2)], key=str),
        "memberships": [(10, 2, "member")], "tags": sorted([(101, "q", None, 10), (102, "r", 2, None)], key=str),
        "assignments": sorted([("o1", 101, None), ("o2", 102, None), ("o3", 102, None)], key=str)}
    left = rows(P.cascade_delete(tables, {"teams": teams.where("team_id = 10"), "tags": tags.where("tag_id = 102")}))
    assert left["tags"] == [(100, "p", 1, None)] and left["assignments"] == [("o1", 100, 2)] and left["memberships"] == []
    assert len(left["users"]) == 2 and len(left["identities"]) == 2
    kinds = {(r.kind, r.key) for r in P.audit_constraints(users.where("user_id = 2"), identities, teams.where("team_id = 11"), mem,
                                                          tags.where("tag_id <> 100"), asg).collect()}
    assert {("identity without user", "orcid|x"), ("membership without team", "10|1"), ("membership without user", "10|1"),
            ("tag without owner team", "101"), ("assignment without tag", "o1|100"), ("assignment applied by no user", "o2|102")} <= kinds


def test_two_updates_of_a_team_are_one_row(spark):
    teams = spark.createDataFrame([(1, "t", "d"), (2, "u", None)], "team_id long, name string, description string")
    up = spark.createDataFrame([(1, " b ", True, None, False), (1, "a", True, "new", True), (1, "  ", True, "x", True), (2, None, False, None, True)],
                               "team_id long, name string, set_name boolean, description string, set_description boolean")
    out, bad = P.apply_team_updates(teams, up)
    assert sorted(map(tuple, out.collect())) == [(1, "a", "new"), (2, "u", None)] and [r.team_id for r in bad.collect()] == [1]


def test_who_may_take_a_tag_off(spark):
    tags = spark.createDataFrame([(100, 1, None), (101, None, 10)], "tag_id long, owner_user_id long, owner_team_id long")
    mem = spark.createDataFrame([(10, 2, "member")], "team_id long, user_id long, role string")
    asg = spark.createDataFrame([("o", 100, 1), ("o", 101, 2)], "object_id string, tag_id long, applied_by long")
    req = spark.createDataFrame([("o", 100, 2), ("o", 101, 2), ("o", 101, 1), ("x", 100, 1), ("o", 999, 1)], "object_id string, tag_id long, user_id long")
    left, judged = P.remove_assignments(req, asg, tags, mem)
    assert [tuple(r) for r in left.collect()] == [("o", 100, 1)]
    assert {(r.object_id, r.tag_id, r.user_id): r.reason for r in judged.collect()} == {
        ("o", 100, 2): "no permission for this tag", ("o", 101, 2): None, ("o", 101, 1): "no permission for this tag",
        ("x", 100, 1): "no such assignment", ("o", 999, 1): "no such assignment"}


def test_a_request_meets_one_tag_of_its_name(spark):
    tags = spark.createDataFrame([(i, "n", None, 1) for i in range(5, 205)] + [(4, "n", 7, None)],
                                 "tag_id long, name string, owner_user_id long, owner_team_id int")
    req = spark.createDataFrame([(i, 7, None, "n", 1 if i % 2 else None) for i in range(200)],
                                "request_id long, user_id long, tag_id long, tag_name string, owner_team_id int")
    mem = spark.createDataFrame([(1, 7, "member")], "team_id int, user_id long, role string")
    out = P.resolve_tag(req, mem, tags)
    assert {(r.request_id % 2, r.tag_id) for r in out.collect()} == {(1, 5), (0, 4)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct(tag_id" in plan  # reduced before the join


def test_components_label_long_ids_by_the_smallest(spark):
    ids = [f"{'x' * 40}{(i * 37) % 60:03d}" for i in range(60)]
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(59) if i % 20 != 19] + [("s", "s"), ("s", None)],
                                  "src string, dst string")
    labels = {r.node: r.label for r in star_components(edges).collect()}
    assert labels == {"s": "s", **{ids[i]: min(ids[i // 20 * 20:i // 20 * 20 + 20]) for i in range(60)}}


def test_assignments_are_grouped_by_key_first(spark):
    plan = td.assignments(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_visible_tags_of_cells_are_those_of_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 5)
    monkeypatch.setattr(P, "PART", 3)
    monkeypatch.setattr(P, "TILE", 2)
    member_rows = [(10, u, "member") for u in range(40)] + [(11, 3, "owner"), (11, 3, "member"), (11, 3, "member"), (12, 1, "owner"),
                                                            (None, 2, "member"), (10, None, "member"), (10, 99, "member")]
    tag_rows = ([(t, f"Tag{t % 7}", None, 10) for t in range(30)] + [(7, "Tag7b", None, 10), (50, "P", 3, None), (51, None, None, 11),
                (None, "N", None, 11), (52, "orphan", None, 13), (53, "both", 1, 11), (54, "neither", None, None)])
    mem = spark.createDataFrame(member_rows, "team_id int, user_id long, role string")
    tags = spark.createDataFrame(tag_rows, "tag_id long, name string, owner_user_id long, owner_team_id long")
    req = spark.createDataFrame([(u,) for u in range(40)] * 2, "user_id long")
    want = [(u, *t) for u in range(40) for t in tag_rows if t[2] == u]
    want += [(u, *t) for team, u, _ in member_rows if u is not None and u < 40 for t in tag_rows if team is not None and t[3] == team]
    got = P.visible_tags(req, mem, tags)
    assert got.columns == ["user_id", *tags.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    teams = spark.createDataFrame([(10, "a"), (11, "b"), (11, "B")], "team_id int, name string")
    users = spark.createDataFrame([(3, "three")], "user_id long, username string")
    rows = P.visible_tag_rows(req, mem, tags, users, teams).where("user_id = 3").collect()
    assert len(rows) == 31 + 3 * 3 * 2 + 1 and {(r.tag_order, r.owner_name) for r in rows if r.tag_id == 53} == {("both", "b"), ("both", "B")}
    assert [(r.tag_order, r.owner_type, r.owner_name) for r in rows if r.tag_id == 50] == [("p", "user", "three")]


def test_one_team_is_listed_by_many_tasks_in_runs_of_a_tag(spark):
    req = spark.range(20_000).select(F.col("id").alias("user_id"))
    mem = req.selectExpr("if(user_id < 0, 2, 1) as team_id", "user_id", "'member' as role")
    tags = spark.range(10).selectExpr("id as tag_id", "concat('t', id) as name", "cast(null as long) as owner_user_id",
                                      "if(id < 0, 2, 1) as owner_team_id")
    got = P.visible_tags(req, mem, tags).select("user_id", "tag_id", F.spark_partition_id().alias("task")).toPandas()
    assert len(got) == 200_000 and not got.duplicated(["user_id", "tag_id"]).any()
    assert got["task"].nunique() > 1
    runs = (got["tag_id"].diff() != 0).sum()
    assert runs < 10 * 60  # ten tags by some 42 tiles of 504 members; member by member it would be 200,000
