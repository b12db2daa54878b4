"""Registered collaboration queries: R1-R16, A9-A11, C15-C17, T5.

Request tables are derived from the driver's tables (every order's
reporter asks about their object, every customer about the parts they
ordered, ...), so each query's work grows with the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import people as P
from ..sources import testdata as td
from .registry import register

V = ("users", "teams", "memberships", "tags", "assignments")

VISIBLE_SQL = """
vis as (select m.user_id, t.tag_id from memberships m join tags t on t.owner_team_id = m.team_id
        union all select owner_user_id, tag_id from tags where owner_user_id is not null)"""


def _t(spark, sf_dir):
    return (td.users(spark, sf_dir), td.teams(spark, sf_dir), td.memberships(spark, sf_dir),
            td.tags(spark, sf_dir), td.assignments(spark, sf_dir))


@register("visible_tags", sql="""
with pu as (select owner_user_id as user_id, count(*) as n, min(name) as f from tags
            where owner_user_id is not null group by 1),
pt as (select m.user_id, sum(x.n) as n, min(x.f) as f from memberships m
       join (select owner_team_id, count(*) as n, min(name) as f from tags where owner_team_id is not null group by 1) x
         on x.owner_team_id = m.team_id group by m.user_id)
select u.user_id, coalesce(pu.n, 0) as n_personal, cast(coalesce(pt.n, 0) as bigint) as n_team,
       cast(coalesce(pu.n, 0) + coalesce(pt.n, 0) as bigint) as n_visible,
       case when pu.f is null then pt.f when pt.f is null then pu.f else least(pu.f, pt.f) end as first_tag
from users u left join pu using (user_id) left join pt using (user_id)
""", views=V)
def q_visible_tags(spark, sf_dir):
    """Per user, visible tags (personal + via teams) and the first name."""
    users, teams, mem, tags, _ = _t(spark, sf_dir)
    return P.visible_tag_counts(users, mem, tags)


@register("visible_tag_rows", sql="""
with o as (
  select t.*, case when t.owner_team_id is not null then 'team' else 'user' end as owner_type,
         coalesce(cast(t.owner_team_id as bigint), t.owner_user_id) as owner_id,
         case when t.owner_team_id is not null then tm.name else u.username end as owner_name
  from tags t left join teams tm on tm.team_id = t.owner_team_id left join users u on u.user_id = t.owner_user_id)
select u.user_id, lower(o.name) as tag_order, o.tag_id, o.name, o.owner_type, o.owner_id, o.owner_name
from users u join o on o.owner_user_id = u.user_id
union all
select m.user_id, lower(o.name), o.tag_id, o.name, o.owner_type, o.owner_id, o.owner_name
from memberships m join o on o.owner_team_id = m.team_id
""", views=("users", "teams", "memberships", "tags"))
def q_visible_tag_rows(spark, sf_dir):
    """Every visible tag of every user, with its owner."""
    users, teams, mem, tags, _ = _t(spark, sf_dir)
    return P.visible_tag_rows(users, mem, tags, users, teams)


@register("object_tags_for_user", sql="""
with req as (select distinct cast(o_orderkey as varchar) as object_id, o_custkey as user_id from orders),
j as (select r.object_id, r.user_id, a.tag_id, t.name, t.owner_user_id, t.owner_team_id, a.applied_by
      from req r join assignments a using (object_id) join tags t using (tag_id))
select *, case when owner_team_id is not null then 'team' else 'user' end as owner_type from j
where owner_user_id = user_id
   or exists (select 1 from memberships m where m.user_id = j.user_id and m.team_id = j.owner_team_id)
""", views=V)
def q_object_tags_for_user(spark, sf_dir):
    """R2: each order's reporter sees the visible tags on their object."""
    users, teams, mem, tags, asg = _t(spark, sf_dir)
    req = td.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("object_id"),
                                                    F.col("o_custkey").alias("user_id"))
    return P.object_tags_for_user(req, mem, tags, asg)


_REQ_TAGS = """
req as (select distinct o.o_custkey as user_id, l.l_partkey as tag_id
        from orders o join lineitem l on l.l_orderkey = o.o_orderkey),
ok as (select r.user_id, r.tag_id from req r join tags t using (tag_id)
       where t.owner_user_id = r.user_id
          or exists (select 1 from memberships m where m.user_id = r.user_id and m.team_id = t.owner_team_id))"""


def _req_tags(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    li = td.table(spark, sf_dir, "lineitem")
    return o.join(li, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("user_id"),
                                                          F.col("l_partkey").alias("tag_id"))


@register("tagged_objects", sql=f"""
with {_REQ_TAGS}
select distinct ok.user_id, a.object_id from ok join assignments a using (tag_id)
""", views=V)
def q_tagged_objects(spark, sf_dir):
    """Per customer, distinct objects carrying the visible tags of
    the parts they ordered."""
    users, teams, mem, tags, asg = _t(spark, sf_dir)
    return P.tagged_objects(_req_tags(spark, sf_dir), mem, tags, asg)


@register("objects_for_tag", sql=f"""
with {_REQ_TAGS},
r as (select ok.user_id, ok.tag_id, a.object_id,
             row_number() over (partition by ok.user_id, ok.tag_id order by a.object_id) as rank
      from ok join assignments a using (tag_id))
select * from r where rank > 1 and rank <= 3
""", views=V)
def q_objects_for_tag(spark, sf_dir):
    """Objects per visible (user, tag) request, ordered, limit 2 offset 1."""
    users, teams, mem, tags, asg = _t(spark, sf_dir)
    return P.objects_for_tag(_req_tags(spark, sf_dir), mem, tags, asg, limit=2, offset=1)


@register("objects_for_tag_keyset", sql=f"""
with {_REQ_TAGS},
c as (select ok.*, case when ok.tag_id % 3 > 0 then cast(ok.tag_id * 7 as varchar) end as after from ok),
r as (select c.user_id, c.tag_id, a.object_id,
             row_number() over (partition by c.user_id, c.tag_id order by a.object_id) as rank
      from c join assignments a using (tag_id) where c.after is null or a.object_id > c.after)
select * from r where rank <= 3
""", views=V)
def q_objects_for_tag_keyset(spark, sf_dir):
    """The page of three objects that follows each request's cursor."""
    _, _, mem, tags, asg = _t(spark, sf_dir)
    req = _req_tags(spark, sf_dir)
    req = req.withColumn("after", F.when(F.col("tag_id") % 3 > 0, (F.col("tag_id") * 7).cast("string")))
    return P.objects_for_tag(req, mem, tags, asg, limit=3)


@register("user_teams", sql="""
select m.user_id, m.team_id, m.role, t.name, t.description from users u join memberships m using (user_id)
left join teams t using (team_id)
""", views=V)
def q_user_teams(spark, sf_dir):
    """Every user's teams with name and description."""
    users, teams, mem, tags, _ = _t(spark, sf_dir)
    return P.user_teams(users, mem, teams)


@register("team_members", sql="""
with req as (select distinct team_id, requester_id from (
  select c_nationkey as team_id, c_custkey as requester_id from customer
  union all select cast((c_custkey * 3) % 25 as int), c_custkey from customer)),
ok as (select * from req r where exists (select 1 from memberships m where m.team_id = r.team_id and m.user_id = r.requester_id))
select m.team_id, cast(null as bigint) as requester_id, m.user_id, m.role, u.username, u.email, cast(null as varchar) as error
from memberships m left join users u on u.user_id = m.user_id where m.team_id in (select team_id from ok)
union all
select team_id, requester_id, null, null, null, null, 'not_a_member'
from req where not exists (select 1 from ok where ok.team_id = req.team_id and ok.requester_id = req.requester_id)
""", views=V)
def q_team_members(spark, sf_dir):
    """Every customer asks for their own team's and another team's
    member list; lists come back once per team, refusals per request."""
    users, teams, mem, tags, _ = _t(spark, sf_dir)
    c = td.table(spark, sf_dir, "customer")
    req = c.select(F.col("c_nationkey").alias("team_id"), F.col("c_custkey").alias("user_id")).unionByName(
        c.select(F.expr("cast((c_custkey * 3) % 25 as int)").alias("team_id"), F.col("c_custkey").alias("user_id")))
    return P.team_members(req, mem, users)


@register("user_by_identity", sql="""
with req as (select distinct case when o_custkey % 3 = 0 then 'orcid' else 'github' end as provider,
                             lpad(cast(o_custkey as varchar), 8, '0') as provider_user_id from orders)
select r.provider, r.provider_user_id, i.user_id, u.username, u.email
from req r left join identities i using (provider, provider_user_id) left join users u on u.user_id = i.user_id
""", views=("users", "identities"))
def q_user_by_identity(spark, sf_dir):
    """(provider, provider id) -> user; unknown identities give NULLs."""
    req = td.table(spark, sf_dir, "orders").selectExpr(
        "case when o_custkey % 3 = 0 then 'orcid' else 'github' end as provider",
        "lpad(cast(o_custkey as string), 8, '0') as provider_user_id").distinct()
    out = P.user_by_identity(req, td.identities(spark, sf_dir), td.users(spark, sf_dir))
    return out.select("provider", "provider_user_id", "user_id", "username", "email")


@register("search_users", sql="""
select * from users
where lower(coalesce(username, '')) like '%customer#00000001%' or lower(coalesce(nickname, '')) like '%customer#00000001%'
   or lower(coalesce(forename, '')) like '%customer#00000001%' or lower(coalesce(surname, '')) like '%customer#00000001%'
   or lower(coalesce(email, '')) like '%customer#00000001%'
order by username asc nulls last, user_id limit 20
""", views=("users",))
def q_search_users(spark, sf_dir):
    """User search, 20 rows, username ascending with NULLs last."""
    return P.search_users(td.users(spark, sf_dir), "  Customer#00000001 ")


@register("search_teams", sql="""
select t.*, coalesce(m.user_id is not null, false) as is_member
from (select * from teams where lower(name) like '%on_1%' or lower(coalesce(description, '')) like '%on_1%'
      order by name, team_id limit 20) t
left join (select team_id, user_id from memberships where user_id = 3) m using (team_id)
""", views=("teams", "memberships"))
def q_search_teams(spark, sf_dir):
    """Team search with the requesting user's membership flag."""
    return P.search_teams(td.teams(spark, sf_dir), td.memberships(spark, sf_dir), " ON_1", 3).select(
        "team_id", "name", "description", "is_member")


@register("merge_identities", sql="""
with inc as (
  select distinct case when o_custkey % 2 = 0 then 'orcid' else 'github' end as provider,
         lpad(cast(o_custkey as varchar), 8, '0') as provider_user_id, cast(null as varchar) as username,
         'Bo' as forename, cast(null as varchar) as surname, 'new' || cast(o_custkey as varchar) || '@x.org' as email
  from orders
  union all
  select distinct 'orcid', 'S' || cast(s_suppkey as varchar), s_name, 'Cy', 'Supplier', null from supplier),
known as (select i.user_id, inc.* exclude (provider, provider_user_id) from inc join identities i using (provider, provider_user_id)),
fresh as (select * from inc where (provider, provider_user_id) not in (select (provider, provider_user_id) from identities))
select u.user_id,
       case when u.username is null or u.username = '' then k.username else u.username end as username,
       case when u.forename is null or u.forename = '' then k.forename else u.forename end as forename,
       case when u.surname is null or u.surname = '' then k.surname else u.surname end as surname,
       case when u.email is null or u.email = '' then k.email else u.email end as email
from users u left join known k using (user_id)
union all
select null, username, forename, surname, email from fresh
""", views=("users", "identities"))
def q_merge_identities(spark, sf_dir):
    """Sign-in profiles merged into users (empty fields filled only),
    unknown identities become new users (their new id left out here)."""
    users = td.users(spark, sf_dir).select("user_id", "username", "forename", "surname", "email")
    o = td.table(spark, sf_dir, "orders")
    inc = o.selectExpr("case when o_custkey % 2 = 0 then 'orcid' else 'github' end as provider",
                       "lpad(cast(o_custkey as string), 8, '0') as provider_user_id", "cast(null as string) as username",
                       "'Bo' as forename", "cast(null as string) as surname",
                       "concat('new', cast(o_custkey as string), '@x.org') as email").distinct()
    sup = td.table(spark, sf_dir, "supplier").selectExpr(
        "'orcid' as provider", "concat('S', cast(s_suppkey as string)) as provider_user_id", "s_name as username",
        "'Cy' as forename", "'Supplier' as surname", "cast(null as string) as email")
    u, _ = P.merge_identities(users, td.identities(spark, sf_dir), inc.unionByName(sup))
    mx = users.agg(F.max("user_id")).first()[0]
    return u.select(F.when(F.col("user_id") <= mx, F.col("user_id")).alias("user_id"),
                    "username", "forename", "surname", "email")


@register("apply_team_updates", sql="""
with upd as (select n_nationkey as team_id,
                    case when n_nationkey in (3, 4) then '  ' else '  ' || n_name || ' team ' end as name,
                    'updated' as description, n_nationkey % 2 = 0 as set_name, n_nationkey % 3 = 0 as set_description
             from nation
             union all select n_nationkey, ' second ' || n_name, null, n_nationkey % 4 = 0, n_nationkey % 5 = 0 from nation),
best as (select team_id, min(trim(name)) filter (where set_name and trim(name) <> '') as name,
                bool_or(set_name and trim(name) <> '') as set_name,
                min(description) filter (where set_description and not (set_name and trim(name) = '')) as description,
                bool_or(set_description and not (set_name and trim(name) = '')) as set_description from upd group by team_id),
bad as (select team_id from upd where set_name and (name is null or trim(name) = ''))
select t.team_id, case when u.set_name then u.name else t.name end as name,
       case when u.set_description then u.description else t.description end as description,
       t.team_id in (select team_id from bad) as has_bad
from teams t left join best u using (team_id)
""", views=("teams",))
def q_apply_team_updates(spark, sf_dir):
    """Two partial updates of every team; blank names rejected, names trimmed."""
    upd = td.table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as team_id",
        "case when n_nationkey in (3, 4) then '  ' else concat('  ', n_name, ' team ') end as name",
        "'updated' as description", "n_nationkey % 2 = 0 as set_name", "n_nationkey % 3 = 0 as set_description")
    second = td.table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as team_id", "concat(' second ', n_name) as name", "cast(null as string) as description",
        "n_nationkey % 4 = 0 as set_name", "n_nationkey % 5 = 0 as set_description")
    out, bad = P.apply_team_updates(td.teams(spark, sf_dir), upd.unionByName(second))
    return out.join(bad.select("team_id", F.lit(True).alias("has_bad")), "team_id", "left").withColumn(
        "has_bad", F.coalesce("has_bad", F.lit(False)))


@register("audit_constraints", sql="""
with users_left as (select * from users where user_id % 50 <> 3), teams_left as (select * from teams where team_id % 9 <> 4),
tags_left as (select * from tags where tag_id % 40 <> 7)
select 'duplicate personal tag name' as kind, cast(owner_user_id as varchar) || '|' || name as key, count(*) as n
from tags_left where owner_user_id is not null group by owner_user_id, name having count(*) > 1
union all
select 'duplicate team tag name', cast(owner_team_id as varchar) || '|' || name, count(*)
from tags_left where owner_team_id is not null group by owner_team_id, name having count(*) > 1
union all
select 'duplicate username', username, count(*) from users_left where username is not null group by username having count(*) > 1
union all
select 'duplicate team name', name, count(*) from teams_left group by name having count(*) > 1
union all
select 'duplicate identity', provider || '|' || provider_user_id, count(*) from identities
group by provider, provider_user_id having count(*) > 1
union all
select 'duplicate assignment', object_id || '|' || cast(tag_id as varchar), count(*) from assignments
group by object_id, tag_id having count(*) > 1
union all
select 'tag owner not exactly one', cast(tag_id as varchar), 1 from tags_left
where (owner_user_id is null) = (owner_team_id is null)
union all
select 'membership without user', cast(team_id as varchar) || '|' || cast(user_id as varchar), 1 from memberships
where user_id not in (select user_id from users_left)
union all
select 'assignment without tag', object_id || '|' || cast(tag_id as varchar), 1 from assignments
where tag_id not in (select tag_id from tags_left)
union all
select 'assignment applied by no user', object_id || '|' || cast(tag_id as varchar), 1 from assignments
where applied_by not in (select user_id from users_left)
union all
select 'identity without user', provider || '|' || provider_user_id, 1 from identities where user_id not in (select user_id from users_left)
union all
select 'membership without team', cast(team_id as varchar) || '|' || cast(user_id as varchar), 1 from memberships
where team_id not in (select team_id from teams_left)
union all
select 'tag without owner user', cast(tag_id as varchar), 1 from tags_left where owner_user_id not in (select user_id from users_left)
union all
select 'tag without owner team', cast(tag_id as varchar), 1 from tags_left where owner_team_id not in (select team_id from teams_left)
union all
select 'team created by no user', cast(team_id as varchar), 1 from teams_left where (team_id * 37) % 1500 not in (select user_id from users_left)
union all
select 'team without owner', cast(team_id as varchar), 1 from memberships group by team_id
having count_if(role = 'owner') = 0
""", views=V + ("identities",))
def q_audit_constraints(spark, sf_dir):
    """Every uniqueness / owner / orphan-key violation in one frame."""
    users, teams, mem, tags, asg = _t(spark, sf_dir)
    users, tags = users.where("user_id % 50 <> 3"), tags.where("tag_id % 40 <> 7")  # rows taken away leave orphans
    teams = teams.where("team_id % 9 <> 4").withColumn("created_by", F.col("team_id") * 37 % 1500)
    return P.audit_constraints(users, td.identities(spark, sf_dir), teams, mem, tags, asg)


@register("insert_memberships", sql="""
with req as (select distinct cast(o_orderkey % 25 as int) as team_id, o_custkey as user_id, 'member' as role
             from orders)
select team_id, user_id, role, cast(null as varchar) as error from memberships
union all select team_id, user_id, role, null from req where (team_id, user_id) not in (select (team_id, user_id) from memberships)
union all select team_id, user_id, null, 'already a member' from req where (team_id, user_id) in (select (team_id, user_id) from memberships)
""", views=("memberships",))
def q_insert_memberships(spark, sf_dir):
    """Every order's reporter asks to join a team; requests are added
    idempotently; all members afterwards, and the rejected requests."""
    req = td.table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey % 25 as int) as team_id", "o_custkey as user_id", "'member' as role").distinct()
    mem, rejected = P.insert_memberships(td.memberships(spark, sf_dir), req)
    return mem.select("team_id", "user_id", "role", F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select("team_id", "user_id", F.lit(None).cast("string").alias("role"), "error"))


def _left_rows(left, created_by=False):
    """Rows of all tables in one frame: table, key, and the columns that a deletion may null."""
    text = lambda *cols: F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    none = F.lit(None).cast("string")
    parts = [left[n].select(F.lit(n).alias("tbl"), text(*key).alias("key"),
                            (F.col(extra).cast("string") if extra in left[n].columns else none).alias("points_at"))
             for n, key, extra in (("users", ["user_id"], None), ("identities", ["provider", "provider_user_id"], "user_id"),
                                   ("teams", ["team_id"], "created_by"), ("memberships", ["team_id", "user_id"], "role"),
                                   ("tags", ["tag_id"], None), ("assignments", ["object_id", "tag_id"], "applied_by")) if n in left]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("cascade_delete", sql="""
with d as (select n_nationkey as team_id from nation where n_regionkey = 0),
dt as (select tag_id from tags where owner_team_id in (select team_id from d) union select tag_id from tags where tag_id % 10 = 9)
select 'teams' as tbl, cast(team_id as varchar) as key, cast(null as varchar) as points_at from teams
  where team_id not in (select team_id from d)
union all select 'memberships', team_id || '|' || user_id, role from memberships where team_id not in (select team_id from d)
union all select 'tags', cast(tag_id as varchar), null from tags where tag_id not in (select tag_id from dt)
union all select 'assignments', object_id || '|' || tag_id, cast(applied_by as varchar) from assignments
  where tag_id not in (select tag_id from dt)
""", views=V)
def q_cascade_delete(spark, sf_dir):
    """Deleting the teams of one region and every tenth tag, with
    everything that hangs off them; the rows that are left."""
    _, teams, mem, tags, asg = _t(spark, sf_dir)
    d = td.table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("team_id"))
    return _left_rows(P.cascade_delete({"teams": teams, "memberships": mem, "tags": tags, "assignments": asg},
                                       {"teams": d, "tags": tags.where("tag_id % 10 = 9")}))


_ACTIONS = "(select * from (values (0, 'delete_team'), (1, 'manage_members'), (2, 'view_members'), " \
           "(3, 'use_team_tags'), (4, 'rename_everything')) t(k, action))"


@register("permission_check", sql=f"""
with roles as (select * from (values ('delete_team', 'owner'), ('update_team', 'owner'),
               ('manage_members', 'owner'), ('manage_members', 'admin'), ('view_members', 'owner'),
               ('view_members', 'admin'), ('view_members', 'member'), ('use_team_tags', 'owner'),
               ('use_team_tags', 'admin'), ('use_team_tags', 'member')) r(action, role)),
req as (select c.c_custkey as user_id, case when c.c_custkey % 4 = 0 then cast((c.c_custkey * 3) % 25 as int)
                                            else c.c_nationkey end as team_id, acts.action
        from customer c join {_ACTIONS} acts on acts.k = c.c_custkey % 5),
j as (select req.*, m.role from req left join memberships m using (team_id, user_id))
select user_id, team_id, action, role,
       reason is null as allowed, reason from (
  select j.*, case when action not in ('delete_team', 'update_team', 'manage_members', 'view_members', 'use_team_tags')
                   then 'unknown action' when role is null then 'not a member'
                   when not exists (select 1 from roles r where r.action = j.action and r.role = j.role)
                   then 'role ' || role || ' may not ' || action end as reason from j)
""", views=("memberships",))
def q_permission_check(spark, sf_dir):
    """Allowed / refused with reason for (user, team, action) requests."""
    c = td.table(spark, sf_dir, "customer")
    acts = spark.createDataFrame([(0, "delete_team"), (1, "manage_members"), (2, "view_members"),
                                  (3, "use_team_tags"), (4, "rename_everything")], "k long, action string")
    req = c.select(F.col("c_custkey").alias("user_id"),
                   F.expr("case when c_custkey % 4 = 0 then cast((c_custkey * 3) % 25 as int) else c_nationkey end")
                   .alias("team_id"), (F.col("c_custkey") % 5).alias("k")).join(F.broadcast(acts), "k").drop("k")
    return P.permission_check(req, td.memberships(spark, sf_dir))


@register("resolve_tag", sql="""
with req as (
  select p_partkey as request_id, p_partkey % 100 as user_id,
         case when p_partkey % 3 = 0 then p_partkey end as tag_id,
         case when p_partkey % 3 <> 0 then concat(p_brand, '-', p_type) end as tag_name,
         case when p_partkey % 3 = 2 then cast(p_partkey % 25 as int) end as owner_team_id
  from part),
cand as (
  select r.request_id, r.user_id, t.tag_id, t.name, t.owner_user_id, t.owner_team_id
  from req r join tags t on r.tag_id is not null and t.tag_id = r.tag_id
  union all
  select r.request_id, r.user_id, t.tag_id, t.name, t.owner_user_id, t.owner_team_id
  from req r join tags t on r.tag_id is null and r.owner_team_id is not null and t.name = r.tag_name
                        and t.owner_team_id = r.owner_team_id
  union all
  select r.request_id, r.user_id, t.tag_id, t.name, t.owner_user_id, t.owner_team_id
  from req r join tags t on r.tag_id is null and r.owner_team_id is null and t.name = r.tag_name
                        and t.owner_user_id = r.user_id),
first as (select * from (select *, row_number() over (partition by request_id, user_id order by tag_id) as rn from cand)
          where rn = 1),
vis as (select f.request_id, f.user_id, f.tag_id, f.name, f.owner_user_id, f.owner_team_id from first f
        where f.owner_user_id = f.user_id
           or exists (select 1 from memberships m where m.user_id = f.user_id and m.team_id = f.owner_team_id))
select *, cast(null as varchar) as error from vis
union all
select request_id, user_id, null, null, null, null, 'unknown_tag' from req
where request_id not in (select request_id from vis)
""", views=("tags", "memberships"))
def q_resolve_tag(spark, sf_dir):
    """Tags resolved by id, by name + team, or by name for oneself;
    only visible tags resolve."""
    req = td.table(spark, sf_dir, "part").selectExpr(
        "p_partkey as request_id", "p_partkey % 100 as user_id",
        "case when p_partkey % 3 = 0 then p_partkey end as tag_id",
        "case when p_partkey % 3 <> 0 then concat(p_brand, '-', p_type) end as tag_name",
        "case when p_partkey % 3 = 2 then cast(p_partkey % 25 as int) end as owner_team_id")
    return P.resolve_tag(req, td.memberships(spark, sf_dir), td.tags(spark, sf_dir))


@register("leave_team_check", sql="""
with req as (select distinct c_nationkey as team_id, c_custkey as user_id from customer),
oc as (select team_id, cast(count_if(role = 'owner') as bigint) as n_owners from memberships group by team_id),
j as (select r.*, m.role, oc.n_owners from req r left join memberships m using (team_id, user_id) left join oc using (team_id))
select team_id, user_id, role,
       case when role is null then 'not a member' when role = 'owner' and n_owners <= 1 then 'sole owner' end is null
         as allowed,
       case when role is null then 'not a member' when role = 'owner' and n_owners <= 1 then 'sole owner' end as reason
from j
""", views=("memberships",))
def q_leave_team_check(spark, sf_dir):
    """Every customer asks to leave their home team; sole owners may not."""
    req = td.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("team_id"), F.col("c_custkey").alias("user_id"))
    return P.leave_team_check(req, td.memberships(spark, sf_dir))


@register("tags_grouped_by_owner", sql="""
select case when t.owner_team_id is not null then 'team' else 'user' end as owner_type,
       coalesce(cast(t.owner_team_id as bigint), t.owner_user_id) as owner_id,
       case when t.owner_team_id is not null then tm.name else u.username end as owner_name,
       count(*) as n_tags, min(t.name) as first_tag, max(t.name) as last_tag,
       case when t.owner_team_id is not null then 1 else 0 end as section_order,
       lower(case when t.owner_team_id is not null then tm.name else u.username end) as sort_name
from tags t left join teams tm on tm.team_id = t.owner_team_id left join users u on u.user_id = t.owner_user_id
group by all
""", views=("tags", "teams", "users"))
def q_tags_grouped_by_owner(spark, sf_dir):
    """A10: tag sections per owner, personal first then teams by name."""
    users, teams, mem, tags, _ = _t(spark, sf_dir)
    return P.tags_grouped_by_owner(P._tag_owner(tags, users, teams))


@register("tag_rows_by_owner", sql="""
select case when t.owner_team_id is not null then 1 else 0 end as section_order,
       lower(case when t.owner_team_id is not null then tm.name else u.username end) as sort_name,
       case when t.owner_team_id is not null then 'team' else 'user' end as owner_type,
       coalesce(cast(t.owner_team_id as bigint), t.owner_user_id) as owner_id,
       case when t.owner_team_id is not null then tm.name else u.username end as owner_name,
       lower(t.name) as tag_order, t.tag_id, t.name
from tags t left join teams tm on tm.team_id = t.owner_team_id left join users u on u.user_id = t.owner_user_id
""", views=("tags", "teams", "users"))
def q_tag_rows_by_owner(spark, sf_dir):
    """A10: every tag in its owner's section."""
    users, teams, mem, tags, _ = _t(spark, sf_dir)
    return P.tag_rows_by_owner(P._tag_owner(tags, users, teams))


@register("user_labels", sql="""
select user_id,
       coalesce(nullif(trim(username), ''), nullif(trim(concat_ws(' ', forename, surname)), ''),
                nullif(trim(email), ''), 'Unnamed user') as label,
       coalesce(nullif(regexp_replace(lower(coalesce(username, email, '')), '[^a-z0-9]', '', 'g'), ''), 'user')
         as username_base
from users
""", views=("users",))
def q_user_labels(spark, sf_dir):
    """Display labels and username bases for every user."""
    u = td.users(spark, sf_dir)
    return u.select("user_id", P.display_label().alias("label"),
                    P.username_base(F.coalesce("username", "email", F.lit(""))).alias("username_base"))


@register("tag_option_labels", sql="""
select t.tag_id, case when t.owner_team_id is not null then t.name || ' (team: ' || coalesce(tm.name, '') || ')'
                      else t.name || ' (personal)' end as label
from tags t left join teams tm on tm.team_id = t.owner_team_id
""", views=("tags", "teams"))
def q_tag_option_labels(spark, sf_dir):
    """C17: tag picker labels."""
    users, teams, mem, tags, _ = _t(spark, sf_dir)
    tw = P._tag_owner(tags, users, teams)
    return tw.select("tag_id", P.tag_option_label(tw).alias("label"))


@register("apply_profile_updates", sql="""
with upd as (select distinct on (o_custkey) o_custkey as user_id, 'nick' || cast(o_custkey % 10 as varchar) as nickname,
                    o_custkey % 2 = 0 as set_nickname, null as email, o_custkey % 5 = 0 as set_email
             from orders order by o_custkey)
select u.user_id, u.username,
       case when p.set_nickname then p.nickname else u.nickname end as nickname, u.forename, u.surname,
       case when p.set_email then null else u.email end as email
from users u left join upd p using (user_id)
""", views=("users",))
def q_apply_profile_updates(spark, sf_dir):
    """Reporters update their profiles; only flagged fields change and
    an email can be cleared (set to NULL)."""
    o = td.table(spark, sf_dir, "orders")
    upd = o.selectExpr("o_custkey as user_id", "concat('nick', cast(o_custkey % 10 as string)) as nickname",
                       "o_custkey % 2 = 0 as set_nickname", "cast(null as string) as forename", "false as set_forename",
                       "cast(null as string) as surname", "false as set_surname", "cast(null as string) as email",
                       "o_custkey % 5 = 0 as set_email")
    return P.apply_profile_updates(td.users(spark, sf_dir), upd)


@register("insert_assignments", sql="""
with req as (select cast(l_orderkey as varchar) as object_id, l_partkey + l_linenumber % 2 as tag_id,
                    min(l_suppkey) as applied_by from lineitem group by 1, 2)
select * from assignments
union all
select * from req where (object_id, tag_id) not in (select (object_id, tag_id) from assignments)
""", views=("assignments",))
def q_insert_assignments(spark, sf_dir):
    """Tagging requests applied idempotently: those of even lines repeat
    existing tags (rejected), those of odd lines ask for the next tag."""
    req = td.table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as string) as object_id", "l_partkey + l_linenumber % 2 as tag_id", "l_suppkey as applied_by")
    out, _ = P.insert_assignments(td.assignments(spark, sf_dir), req)
    return out


@register("cascade_delete_users", sql="""
with d as (select c_custkey as user_id from customer where c_acctbal < 0),
dt as (select tag_id from tags where owner_user_id in (select user_id from d))
select 'users' as tbl, cast(user_id as varchar) as key, cast(null as varchar) as points_at from users
  where user_id not in (select user_id from d)
union all select 'identities', provider || '|' || provider_user_id, cast(user_id as varchar) from identities
  where user_id not in (select user_id from d)
union all select 'teams', cast(team_id as varchar),
  case when (team_id * 37) % 1500 in (select user_id from d) then null else cast((team_id * 37) % 1500 as varchar) end from teams
union all select 'memberships', team_id || '|' || user_id, role from memberships where user_id not in (select user_id from d)
union all select 'tags', cast(tag_id as varchar), null from tags where tag_id not in (select tag_id from dt)
union all select 'assignments', object_id || '|' || tag_id,
  case when applied_by in (select user_id from d) then null else cast(applied_by as varchar) end
  from assignments where tag_id not in (select tag_id from dt)
""", views=V + ("identities",))
def q_cascade_delete_users(spark, sf_dir):
    """Deleting the users with a negative balance: their identities,
    memberships and personal tags (and those tags' assignments) go; teams they
    created and assignments they applied stay with a NULL."""
    users, teams, mem, tags, asg = _t(spark, sf_dir)
    d = td.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    teams = teams.withColumn("created_by", (F.col("team_id") * 37 % 1500).cast("long"))
    return _left_rows(P.cascade_delete({"users": users, "identities": td.identities(spark, sf_dir), "teams": teams,
                                        "memberships": mem, "tags": tags, "assignments": asg}, {"users": d}))


@register("remove_assignments", sql="""
with req as (select distinct object_id, tag_id + case when cast(object_id as bigint) % 7 = 0 then 100000 else 0 end as tag_id,
    case cast(object_id as bigint) % 3 when 0 then tag_id % 100 else cast(object_id as bigint) % 150 end as user_id from assignments
    where tag_id % 4 < 3),
own as (select req.*, t.owner_user_id, t.owner_team_id, exists (select 1 from assignments a where a.object_id = req.object_id
    and a.tag_id = req.tag_id) as found from req left join tags t using (tag_id)),
j as (select own.*, case when not found then 'no such assignment' when owner_user_id is null and owner_team_id is null then 'unknown tag'
    when owner_user_id = user_id or exists (select 1 from memberships m where m.team_id = own.owner_team_id and m.user_id = own.user_id)
    then null else 'no permission for this tag' end as reason from own)
select 'request' as tbl, object_id, tag_id, user_id, reason is null as removed, reason from j
union all select 'left', object_id, tag_id, null, null, null from assignments a
where not exists (select 1 from j where j.object_id = a.object_id and j.tag_id = a.tag_id and reason is null)
""", views=V)
def q_remove_assignments(spark, sf_dir):
    """R15 + R14: requests to take tags off objects, allowed for a personal
    tag's owner and the owning team's members; requests and what is left."""
    _, _, mem, tags, asg = _t(spark, sf_dir)
    o = F.col("object_id").cast("long")
    req = asg.where("tag_id % 4 < 3").select(
        "object_id", (F.col("tag_id") + F.when(o % 7 == 0, 100000).otherwise(0)).alias("tag_id"),
        F.when(o % 3 == 0, F.col("tag_id") % 100).otherwise(o % 150).alias("user_id")).distinct()
    left, judged = P.remove_assignments(req, asg, tags, mem)
    return judged.withColumn("tbl", F.lit("request")).unionByName(
        left.select("object_id", "tag_id", F.lit("left").alias("tbl")), allowMissingColumns=True)
