"""Archive searches: attribute search (F4), alert conditions (F5), cone
request validation and links (F7, C10), paging (T2, T3).

Searches are built as Column expressions (``exists`` / ``forall`` over the
document's arrays), never as SQL text, so user values cannot change the
query's shape; the reference's character screen is kept as validation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Operators accepted by the search endpoint, and the
# character sequences it refuses inside values.
VALID_OPERATORS = ["<", ">", "=", "<=", ">=", "IN", "LIKE"]
FORBIDDEN = [";", "/*", "*/", "--"]
SEARCH_PARAMS = ("value", "filter", "mjd")


def _compare(x: Column, op: str, v) -> Column:
    if op == "<":
        return x < F.lit(v)
    if op == ">":
        return x > F.lit(v)
    if op == "=":
        return x == F.lit(v)
    if op == "<=":
        return x <= F.lit(v)
    if op == ">=":
        return x >= F.lit(v)
    if op == "IN":
        return x.isin(list(v) if isinstance(v, (list, tuple)) else [v])
    if op == "LIKE":
        return x.like(str(v))
    raise ValueError(f"bad operator {op}")


def _check_value(v):
    items = v if isinstance(v, list) else [v]
    for item in items:
        if any(s in str(item) for s in FORBIDDEN):
            raise ValueError(f"search field contains invalid characters {item}")
    if isinstance(v, bool) or not isinstance(v, (int, float, str, list)):
        raise ValueError(f"bad search value {v}")


def _all_of(preds):
    # one-argument lambdas only: PySpark reads the arity of the function
    return lambda x: reduce(lambda a, b: a & b, [_compare(x[k], op, v) for k, op, v in preds], F.lit(True))


def search_condition(search: dict) -> Column:
    """``{field: [{value|filter|mjd: v, operator: op}, ...]}`` -> a
    boolean Column: for every field, some element satisfies all its
    params; fields are ANDed; an empty search matches everything (D7)."""
    conds = []
    for field, params in search.items():
        preds = []
        for p in params:
            key = next((k for k in SEARCH_PARAMS if k in p), None)
            if key is None:
                raise ValueError(f"bad search option {p}")
            op = p.get("operator")
            if op not in VALID_OPERATORS:
                raise ValueError(f"bad operator {op}")
            _check_value(p[key])
            preds.append((key, op, p[key]))

        conds.append(F.coalesce(F.exists(F.col(field), _all_of(preds)), F.lit(False)))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def search_objects(df: DataFrame, search: dict, id_col: str = "obj_id") -> DataFrame:
    """ids of documents matching the search."""
    return df.where(search_condition(search)).select(id_col)


# --- F5 ------------------------------------------------------------------

def _field_check(x: Column, cond: dict) -> Column:
    checks = []
    op = cond.get("operator")
    if not ({"date_limit", "value", "mag_rate", "filter"} & set(cond)):
        return F.lit(False)
    if "date_limit" in cond:
        # Compare the parsed date with the cutoff
        checks.append(_compare(F.try_to_timestamp(x["value"].cast("string")), op, cond["date_limit"]))
    if "value" in cond:
        v = cond["value"]
        checks.append(x["value"].isin(v) if isinstance(v, list) else _compare(x["value"], op, v))
    if "mag_rate" in cond:
        # The rate is compared, not the value
        checks.append(_compare(x["mag_rate"], op, cond["mag_rate"]))
    if "filter" in cond:
        checks.append(x["filter"] == F.lit(cond["filter"]))
    return reduce(lambda a, b: a & b, checks)


def _checker(cond):
    return lambda x: F.coalesce(_field_check(x, cond), F.lit(False))


def _of_source(src):
    return lambda x: x["source"] == F.lit(src)


def alert_condition(conditions: dict, columns) -> Column:
    """does a document satisfy the monitoring conditions?

    Per field and condition the source quantifier is ``any`` (some element),
    ``all`` (every element) or a source name (every element of that source,
    vacuously true when there is none).  A field missing from the document
    fails the whole test; so does a NULL array."""
    terms = []
    for field, conds in conditions.items():
        if field not in columns:
            return F.lit(False)
        arr = F.col(field)
        for cond in conds:
            src = cond.get("source", "any")

            chk = _checker(cond)
            if src == "any":
                t = F.exists(arr, chk)
            elif src == "all":
                t = F.forall(arr, chk)
            else:
                t = F.forall(F.filter(arr, _of_source(src)), chk)
            terms.append(F.coalesce(t, F.lit(False)))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def match_alert_conditions(df: DataFrame, conditions: dict) -> DataFrame:
    """F5 / ST4: documents (batch or stream) that meet the conditions."""
    return df.where(alert_condition(conditions, df.columns))


# --- F7, C10 -------------------------------------------------------------

def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def validate_cones(req: DataFrame, ra="ra", dec="dec", radius="radius") -> DataFrame:
    """text cone requests -> parsed doubles plus ``status`` (``ok``,
    ``none`` when all three are absent, ``error``) and an ``error`` code."""
    r, d, s = F.col(ra), F.col(dec), F.col(radius)
    rv, dv, sv = (F.trim(x).try_cast("double") for x in (r, d, s))
    missing = F.concat_ws(",", F.when(_blank(r), F.lit("ra")), F.when(_blank(d), F.lit("dec")),
                          F.when(_blank(s), F.lit("radius")))
    err = (F.when(_blank(r) & _blank(d) & _blank(s), F.lit(None))
           .when(missing != "", F.concat(F.lit("missing:"), missing))
           .when(rv.isNull() | dv.isNull() | sv.isNull(), F.lit("not_a_number"))
           .when((rv < 0) | (rv > 360), F.lit("ra_out_of_range"))
           .when((dv < -90) | (dv > 90), F.lit("dec_out_of_range"))
           .when(sv <= 0, F.lit("radius_not_positive")))
    status = F.when(_blank(r) & _blank(d) & _blank(s), "none").when(err.isNotNull(), "error").otherwise("ok")
    ok = status == "ok"
    return req.select("*", F.when(ok, rv).alias("ra_deg"), F.when(ok, dv).alias("dec_deg"),
                      F.when(ok, sv).alias("radius_arcsec"), status.alias("status"), err.alias("error"))


def _short_number(x: Column) -> Column:
    """Up to six decimals, trailing zeros dropped (``%g`` for plain radii)."""
    s = x.cast("decimal(24,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")


def cone_query_string(ra, dec, radius) -> Column:
    """C10 build: ``?ra=%.6f&dec=%.6f&radius=<short>``."""
    return F.concat(F.format_string("?ra=%.6f&dec=%.6f&radius=", F.col(ra).cast("double"), F.col(dec).cast("double")),
                    _short_number(F.col(radius).cast("double")))


def parse_cone_query(df: DataFrame, qs: str = "query") -> DataFrame:
    """C10 parse: query string -> the three fields, then F7 validation."""
    url = F.concat(F.lit("http://x/"), F.when(F.col(qs).startswith("?"), F.col(qs)).otherwise(
        F.concat(F.lit("?"), F.col(qs))))
    parts = df.select("*", *[F.parse_url(url, F.lit("QUERY"), F.lit(k)).alias(f"_{k}") for k in ("ra", "dec", "radius")])
    return validate_cones(parts, "_ra", "_dec", "_radius").drop("_ra", "_dec", "_radius")


# --- T2, T3 --------------------------------------------------------------

ALERTS_PER_PAGE = 25
CONES_PER_PAGE = 20
#: Hash slices of a group that deep pages are cut in.
SLICES = 64


def alerts_page(meta: DataFrame, n_rows, offset=0, after: tuple | None = None) -> DataFrame:
    """One page of the TNS alert list, newest discovery first.

    ``meta`` has the envelope (source, source_id, discovery_date, ra_hms,
    dec_dms) and ``data_sources`` (source -> JSON payload); type, redshift,
    reporting group and discovery source come from the ``tns`` payload.
    Paging values must be integers (as in Python, booleans count).  Spark
    plans ``orderBy + offset + limit`` as a top-k (TakeOrderedAndProject),
    so only offset+n rows per task are kept.  ``after`` is a cursor for deep
    pages, the (discovery_date, obj_name) of the last row of the page before:
    a range filter that reaches the scan, so page 1,000 keeps and sorts no more
    than page 1."""
    for v in (n_rows, offset):
        if not isinstance(v, int) or v < 0:
            raise ValueError("n_rows/offset must be an integer")
    tns = F.col("data_sources")["tns"]
    listed = meta.where(F.col("source") == "tns")
    if after is not None:
        day, name = F.lit(after[0]), F.lit(after[1])
        listed = listed.where((F.col("discovery_date") <= day)  # pushed to the scan; the tie is settled here
                              & ((F.col("discovery_date") < day) | (F.col("source_id") > name)))
    page = (listed.orderBy(F.col("discovery_date").desc(), F.col("source_id"))
            .offset(int(offset)).limit(int(n_rows)))
    return page.select("discovery_date", F.col("source_id").alias("obj_name"),
                       F.get_json_object(tns, "$.object_type").alias("object_type"), "ra_hms", "dec_dms",
                       F.get_json_object(tns, "$.redshift").try_cast("double").alias("redshift"),
                       F.get_json_object(tns, "$.reporting_group").alias("reporting_group"),
                       F.get_json_object(tns, "$.discovery_data_source").alias("discovery_source"))


#: Bins of a doubling of the distance.
PAGE_BINS = 16


def page_reach(results: DataFrame, page: int, size: int = CONES_PER_PAGE, group: str = "cone_id",
               by: str = "distance_deg", rows: str | None = None) -> DataFrame:
    """(group, n_pages, reach): each group's page count (at least 1) and a
    bound of ``by`` that no row up to the end of the page is beyond.  Rows are
    counted by logarithmic bins of ``by`` within the tasks that find them, so
    what is shuffled is bins, not rows.  ``rows``: column of the number of rows
    that a row stands for, none of them beyond its ``by`` (``sky.cone_cells``)."""
    binned = F.greatest(F.lit(-1074 * PAGE_BINS), F.floor(F.log2(F.when(F.col(by) > 0, F.col(by))) * PAGE_BINS)).cast("int")
    counts = results.groupBy(group, binned.alias("_bin")).agg((F.count("*") if rows is None else F.sum(rows)).alias("_n"))
    w = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    top = F.pow(F.lit(2.0), (F.col("_bin") + 1) / PAGE_BINS) * (1 + 1e-9)
    return counts.groupBy(group).agg(
        F.greatest(F.lit(1), F.ceil(F.sum("_n") / F.lit(size))).cast("long").alias("n_pages"),
        F.max(F.when(F.col("_before") < page * size, top)).alias("reach"))


def page_slice(results: DataFrame, page: int, size: int = CONES_PER_PAGE, group: str = "cone_id",
               order=("distance_deg", "obj_name"), counts: DataFrame | None = None) -> DataFrame:
    """Page ``page`` (1-based) of each group's ordered results, with the
    group's page count (at least 1).

    A first pass cuts every group to the rows that can be on the page within
    ``SLICES`` hash slices, in parallel; the second ranks what is left.  A
    row on the page is among the first ``page * size`` of its slice, so at
    any depth a task gets one slice of a group and then at most
    ``SLICES * page * size`` rows of it, never a whole group.

    ``counts``: (group, n_pages) when they are known (``page_reach``); the
    results then need to hold no more than what its reach lets through."""
    last = page * size
    sliced = results.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)))
    first = Window.partitionBy(group, "_slice").orderBy(*order)
    cut = sliced.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= last).drop("_nth", "_slice")
    ranked = (cut.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
              .where(F.col("rank") <= last).withColumn("rank", F.col("rank").cast("long")))
    if counts is None:
        counts = results.groupBy(group).agg(
            F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(size))).cast("long").alias("n_pages"))
    return ranked.where(F.col("rank") > last - size).join(counts.select(group, "n_pages"), group)


# --- long forms (one row per array element) -------------------------------

def _compare_text(x: Column, op: str, v) -> Column:
    """Compare a text value column with a literal: numbers numerically."""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return _compare(x.try_cast("double"), op, float(v))
    if isinstance(v, (list, tuple)):
        return _compare(x, op, [str(i) for i in v])
    return _compare(x, op, v)


def search_objects_long(rows: DataFrame, search: dict, id_col: str = "obj_id", field_col: str = "field") -> DataFrame:
    """F4 over long rows ``(id, field, value, filter, mjd)``: the same answer
    as ``search_objects`` on documents, computed without building arrays.
    Matching rows are reduced to (id, field) pairs and counted per id, so an
    object with a huge array is handled by partial aggregation."""
    ids = rows.select(id_col).distinct()
    if not search:
        return ids
    conds = []
    for field, params in search.items():
        preds = []
        for p in params:
            key = next((k for k in SEARCH_PARAMS if k in p), None)
            if key is None:
                raise ValueError(f"bad search option {p}")
            if p.get("operator") not in VALID_OPERATORS:
                raise ValueError(f"bad operator {p.get('operator')}")
            _check_value(p[key])
            preds.append(_compare(F.col(key), p["operator"], p[key]))
        conds.append((F.col(field_col) == field) & reduce(lambda a, b: a & b, preds))
    hit = rows.where(reduce(lambda a, b: a | b, conds)).select(id_col, field_col).distinct()
    return hit.groupBy(id_col).agg(F.count("*").alias("_n")).where(F.col("_n") == len(search)).select(id_col)


def _row_check(cond: dict) -> Column:
    op = cond.get("operator")
    if not ({"date_limit", "value", "mag_rate", "filter"} & set(cond)):
        return F.lit(False)
    checks = []
    if "date_limit" in cond:
        checks.append(_compare(F.try_to_timestamp(F.col("value")), op, cond["date_limit"]))
    if "value" in cond:
        v = cond["value"]
        checks.append(F.col("value").isin([str(i) for i in v]) if isinstance(v, list) else _compare_text(F.col("value"), op, v))
    if "mag_rate" in cond:
        checks.append(_compare(F.col("mag_rate"), op, cond["mag_rate"]))
    if "filter" in cond:
        checks.append(F.col("filter") == F.lit(cond["filter"]))
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def match_alert_conditions_long(rows: DataFrame, conditions: dict, id_col: str = "obj_id",
                                field_col: str = "field") -> DataFrame:
    """F5 over long rows ``(id, field, source, value, filter, mag_rate)``:
    ``any`` = some row passes, ``all`` = no row fails, a source name = no row
    of that source fails; a field without rows fails.  One aggregate of
    ``count_if`` terms per id."""
    aggs, tests = [], []
    for i, (field, conds) in enumerate(conditions.items()):
        in_f = F.col(field_col) == field
        aggs.append(F.count_if(in_f).alias(f"_p{i}"))
        tests.append(F.col(f"_p{i}") > 0)
        for j, cond in enumerate(conds):
            src, ok = cond.get("source", "any"), _row_check(cond)
            name = f"_c{i}_{j}"
            if src == "any":
                aggs.append(F.count_if(in_f & ok).alias(name))
                tests.append(F.col(name) > 0)
            else:
                scope = in_f if src == "all" else in_f & (F.col("source") == src)
                aggs.append(F.count_if(scope & ~ok).alias(name))
                tests.append(F.col(name) == 0)
    per = rows.groupBy(id_col).agg(*aggs)
    return per.where(reduce(lambda a, b: a & b, tests)).select(id_col)
