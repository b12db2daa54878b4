"""Foreign keys of the collaboration tables, declared once.

``FOREIGN_KEYS`` says which column points at which table and what happens to a
row whose parent is deleted.  Two operators follow from it: ``delete_rows``
(R14), the whole closure of a deletion, and ``orphans`` (R12), the rows whose
parent does not exist.  Both are joins on the keys; the keys of deleted rows
are a table of their own, so a deleted team with a third of all rows under it
is joined, not gathered.

Defined results: a null key points at nothing and is kept; a key column that a
table lacks is skipped; deleting what does not exist changes nothing; repeated
keys count once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Primary keys, parents before children, and the foreign keys.
PRIMARY_KEYS = {
    "users": ["user_id"],
    "identities": ["provider", "provider_user_id"],
    "teams": ["team_id"],
    "memberships": ["team_id", "user_id"],
    "tags": ["tag_id"],
    "assignments": ["object_id", "tag_id"],
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    on_delete: str  # CASCADE or SET NULL
    orphan: str  # how an audit names a row without its parent


FOREIGN_KEYS = (
    ForeignKey("identities", "user_id", "users", "CASCADE", "identity without user"),
    ForeignKey("teams", "created_by", "users", "SET NULL", "team created by no user"),
    ForeignKey("memberships", "team_id", "teams", "CASCADE", "membership without team"),
    ForeignKey("memberships", "user_id", "users", "CASCADE", "membership without user"),
    ForeignKey("tags", "owner_user_id", "users", "CASCADE", "tag without owner user"),
    ForeignKey("tags", "owner_team_id", "teams", "CASCADE", "tag without owner team"),
    ForeignKey("assignments", "tag_id", "tags", "CASCADE", "assignment without tag"),
    ForeignKey("assignments", "applied_by", "users", "SET NULL", "assignment applied by no user"),
)


def _keys_of(tables: dict[str, DataFrame], child: str, parents) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.child == child and fk.parent in parents and fk.column in tables[child].columns]


def _pointing(keys: DataFrame, fk: ForeignKey) -> DataFrame:
    """The parent's keys under the name of the child's column."""
    return keys.select(F.col(PRIMARY_KEYS[fk.parent][0]).alias(fk.column)).distinct()


def delete_rows(tables: dict[str, DataFrame], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of ``tables`` when the rows whose primary keys are in
    ``deleted`` go: rows that point at a deleted one by a CASCADE key go too,
    and so on; by a SET NULL key they stay without it."""
    dead: dict[str, DataFrame] = {}
    left: dict[str, DataFrame] = {}
    for name in [n for n in PRIMARY_KEYS if n in tables]:
        df, key = tables[name], PRIMARY_KEYS[name]
        fks = _keys_of(tables, name, dead)
        gone = [df.select(*key).join(deleted[name].select(*key).distinct(), key, "left_semi")] if name in deleted else []
        gone += [df.join(_pointing(dead[fk.parent], fk), fk.column, "left_semi").select(*key)
                 for fk in fks if fk.on_delete == "CASCADE"]
        if gone:
            dead[name] = reduce(DataFrame.unionByName, gone).distinct()
        kept = df.join(deleted[name].select(*key).distinct(), key, "left_anti") if name in deleted else df
        for fk in fks:
            lost = _pointing(dead[fk.parent], fk)
            if fk.on_delete == "CASCADE":
                kept = kept.join(lost, fk.column, "left_anti")
            else:
                kept = (kept.join(lost.withColumn("_gone", F.lit(True)), fk.column, "left")
                        .withColumn(fk.column, F.when(F.col("_gone").isNull(), F.col(fk.column))).drop("_gone"))
        left[name] = kept.select(*df.columns)
    return left


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, key, n) of every row that points at no row of its parent."""
    parts = []
    for fk in FOREIGN_KEYS:
        if fk.child in tables and fk.parent in tables and fk.column in tables[fk.child].columns:
            child = tables[fk.child].where(F.col(fk.column).isNotNull())
            alone = child.join(_pointing(tables[fk.parent], fk), fk.column, "left_anti")
            shown = F.concat_ws("|", *[F.col(c).cast("string") for c in PRIMARY_KEYS[fk.child]])
            parts.append(alone.select(F.lit(fk.orphan).alias("kind"), shown.alias("key"), F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, parts)
