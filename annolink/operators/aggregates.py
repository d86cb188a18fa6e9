"""Counts, coverage, accuracy and group reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c, id_list, norm_text, try_float
from .ranking import rank_rows
from .scan import number_rows


# AG-01 -----------------------------------------------------------------
def count_by(df: DataFrame, *dim_sets: Sequence[str]) -> DataFrame:
    """Row counts of several groupings in one pass: dimension columns, grouping (its name), n."""
    dims = list(dict.fromkeys(d for s in dim_sets for d in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in dim_sets], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__g"))
    # grouping_id has one bit per dimension, set where the dimension is folded
    names = {sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s): "*".join(s) or "all" for s in dim_sets}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return out.withColumn("grouping", label[F.col("__g").cast("int")]).drop("__g")


# AG-02 -----------------------------------------------------------------
def class_pivot(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts of each value per row, with a total. The values are given, so no extra pass is needed."""
    aggs = [F.count_if(F.col(col) == v).alias(str(v)) for v in values]
    return df.groupBy(row).agg(*aggs, F.count_if(F.col(col).isin(list(values))).alias("total"))


# AG-03 -----------------------------------------------------------------
def score_inventory(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts per score and whether pages, new-page breaks and label pages agree.

    nodes: score_id, tag, attributes map. pages: score_id, images, labels (counts).
    """
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    tag = F.col("tag")
    n = nodes.groupBy("score_id").agg(
        F.count_if(tag == "measure").alias("measures"), (F.count_if((tag == "print") & (at("new-page") == "yes")) + 1).alias("xml_pages"),
        F.count_if(tag == "repeat").alias("repeats"), F.count_if(tag == "ending").alias("endings"), F.count_if(tag == "note").alias("notes"))
    out = n.join(pages, "score_id", "full_outer")
    direct = (F.col("xml_pages") == F.col("images")) & (F.col("images") == F.col("labels"))
    return out.withColumn("mapping_status", F.when(direct, "direct").otherwise("needs_alignment"))


# AG-04 -----------------------------------------------------------------
def page_manifest(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Label totals, invalid rows and readiness per page; the class counts are a table of their own.

    labels: page_id, class, valid. images: page_id, length, sha256 (or NULL).
    """
    n = labels.groupBy("page_id").agg(F.count_if("valid").alias("label_rows"), F.count_if(~F.col("valid")).alias("invalid_rows"))
    out = n.join(images, "page_id", "full_outer").fillna(0, ["label_rows", "invalid_rows"])
    ready = (
        F.when(F.col("length").isNull(), "missing_image").when(F.col("label_rows") + F.col("invalid_rows") == 0, "missing_labels")
        .when(F.col("invalid_rows") > 0, "invalid_labels").otherwise("ready"))
    return out.withColumn("readiness", ready)


def page_classes(labels: DataFrame) -> DataFrame:
    """Map of class counts per page (as many entries as the page has classes)."""
    c = labels.where("valid").groupBy("page_id", "class").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("class_counts"))


# AG-05 -----------------------------------------------------------------
def coverage(expected: DataFrame, used: DataFrame, key: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(report per group and in total, issues): share of expected ids in use, and both left-overs."""
    e = expected.select(group, key).distinct()
    u = used.select(group, key).where(F.col(key).isNotNull()).distinct()
    j = e.withColumn("__e", F.lit(True)).join(u.withColumn("__u", F.lit(True)), [group, key], "full_outer")
    inside = F.col("__e").isNotNull()
    rep = j.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.count_if(inside).alias("expected"), F.count_if(inside & F.col("__u").isNotNull()).alias("referenced"), F.grouping_id().alias("__g"))
    rep = rep.withColumns({
        "scope": F.when(F.col("__g") == 0, "group").otherwise("total"),
        "coverage": F.when(F.col("expected") == 0, 1.0).otherwise(F.round(F.col("referenced") / F.greatest("expected", F.lit(1)), 6))}).drop("__g")
    issues = j.where("__e is null or __u is null").select(
        group, key, F.when(F.col("__u").isNull(), "unreferenced").otherwise("unknown_reference").alias("issue"))
    return rep, issues


# AG-06 -----------------------------------------------------------------
def equivalent(field: str, actual, expected) -> Column:
    """Equal values: times within 0.0005, id lists element by element, other fields as text."""
    a, e = F.coalesce(norm_text(actual), F.lit("")), F.coalesce(norm_text(expected), F.lit(""))
    if field in ("start_meas", "end_meas"):
        x, y = try_float(a), try_float(e)
        return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= 0.0005).otherwise(a == e)
    if field == "connected_note":
        return id_list(a) == id_list(e)
    return a == e


def accuracy(items: DataFrame, fields: Sequence[str], row_id: Sequence[str], cls: str = "class", action: str = "action") -> DataFrame:
    """Evaluated and correct counts per class and field, per field, per class (exact rows) and overall.

    items: row_id, class, action, and for every field the columns machine_<f>, expected_<f>.
    A field counts where something is expected, or on a rejected row.
    """
    reject = F.col(action) == "reject"
    cells = [
        F.struct(F.lit(f).alias("field"), (reject | norm_text(f"expected_{f}").isNotNull()).alias("eligible"), equivalent(f, f"machine_{f}", f"expected_{f}").alias("ok"))
        for f in fields]
    cells = F.array(*cells)
    live = F.filter(cells, lambda c: c["eligible"])
    exact = (F.size(live) > 0) & F.forall(live, lambda c: c["ok"])
    row = F.array(F.struct(F.lit("__row").alias("field"), F.lit(True).alias("eligible"), exact.alias("ok")))
    long = items.select(F.col(cls).alias("class"), F.explode(F.concat(cells, row)).alias("c")).select("class", "c.*").where("eligible")
    out = long.groupingSets([[F.col("class"), F.col("field")], [F.col("field")]], F.col("class"), F.col("field")).agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if("ok").alias("correct"), F.grouping_id().alias("__g"))
    return out.select(
        F.when(F.col("__g") == 0, "class").otherwise("overall").alias("scope"), "class",
        F.when(F.col("field") == "__row", "exact_row").otherwise(F.col("field")).alias("field"), "evaluated", "correct",
        F.round(F.col("correct") / F.col("evaluated"), 6).alias("accuracy"))


# AG-07 -----------------------------------------------------------------
def evaluate(truth: DataFrame, pred: DataFrame, keys, fields: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accuracy, missing predictions, class mismatches) of predictions against truth.

    truth: keys, class, expected_<f>. pred: keys, class, <f>.
    """
    keys = list(keys)
    p = pred.select(*keys, F.col("class").alias("__pc"), F.lit(True).alias("__hit"), *[F.col(f).alias(f"machine_{f}") for f in fields])
    j = truth.join(p, keys, "left")
    missing = j.where("__hit is null").select(*keys)
    both = j.where("__hit")
    tc = norm_text("class")
    mismatch = both.where(tc.isNotNull() & ~tc.eqNullSafe(norm_text("__pc"))).select(*keys, F.col("class").alias("expected"), F.col("__pc").alias("actual"))
    items = both.withColumns({"class": F.coalesce(tc, norm_text("__pc")), "action": F.lit("ground_truth")})
    return accuracy(items, fields, keys), missing, mismatch


# AG-08 -----------------------------------------------------------------
def sweep(rows: DataFrame, profiles: Sequence[dict], predicted: str, confidence: str, truth: str) -> DataFrame:
    """Outcome counts for each parameter profile (name, min_confidence, accept) in one pass.

    predicted and truth are arrays. Below min_confidence a row is unresolved; any shared id
    is exact. The profiles are constants inside the expression.
    """
    arr = F.array(*[F.struct(F.lit(p["name"]).alias("profile"), F.lit(float(p["min_confidence"])).alias("lo"), F.lit(float(p["accept"])).alias("accept")) for p in profiles])
    x = rows.select(predicted, confidence, truth, F.explode(arr).alias("p"))
    kept = (F.size(predicted) > 0) & (F.col(confidence) >= F.col("p.lo"))
    hit = F.arrays_overlap(predicted, truth)
    auto = kept & (F.col(confidence) >= F.col("p.accept"))
    return x.groupBy("p.profile").agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(kept & hit).alias("exact"), F.count_if(kept & ~hit).alias("wrong"), F.count_if(~kept).alias("unresolved"),
        F.count_if(auto).alias("auto_accepted"), F.count_if(auto & hit).alias("auto_exact"), F.count_if(auto & ~hit).alias("auto_wrong"))


# AG-09 -----------------------------------------------------------------
def manual_groups(manual: DataFrame, keys, bbox: str = "bbox_id", cls: str = "class", status: str = "source_status", confidence: str = "confidence",
                  sets: Sequence[str] = ()) -> DataFrame:
    """Review groups: size, distinct classes and statuses, confidence range, rank (ambiguous first).

    The members stay rows of `manual` (see group_members); only distinct values are nested.
    """
    keys = list(keys)
    conf = F.coalesce(try_float(confidence), F.lit(0.0))
    amb = F.bool_or(F.col(status) == "ambiguous")
    g = manual.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("group_size"), F.sort_array(F.collect_set(cls)).alias("classes"), F.sort_array(F.collect_set(status)).alias("statuses"),
        F.min(conf).alias("min_confidence"), F.max(conf).alias("max_confidence"), F.when(amb, "P1_ambiguous").otherwise("P2_candidate").alias("priority_tier"),
        *[F.sort_array(F.collect_set(s)).alias(f"{s}s") for s in sets])
    return rank_rows(g, ["priority_tier", "min_confidence", *keys], "group_rank").withColumn("group_id", F.format_string("G%05d", "group_rank"))


def group_members(manual: DataFrame, groups: DataFrame, keys, bbox="bbox_id", status="source_status", confidence="confidence", cells=()) -> DataFrame:
    """Members with their group and their position in it (ambiguous first, then low confidence)."""
    d = manual.withColumns({"__a": F.when(F.col(status) == "ambiguous", 0).otherwise(1), "__c": F.coalesce(try_float(confidence), F.lit(0.0))})
    d = number_rows(d, keys, ["__a", "__c", bbox], "group_member_index", cells).drop("__a", "__c")
    return d.join(groups.select(*keys, "group_id", "group_rank"), list(keys))


# AG-10 -----------------------------------------------------------------
def batches(queue: DataFrame, batch: str = "batch_id", status="source_status", confidence="confidence", rank="queue_rank") -> DataFrame:
    """Rows, ambiguous and candidate counts and confidence range per batch, ordered by best rank."""
    conf = try_float(confidence)
    b = queue.groupBy(batch).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(status) == "ambiguous").alias("ambiguous"), F.count_if(F.col(status) == "candidate").alias("candidate"),
        F.min(conf).alias("min_confidence"), F.max(conf).alias("max_confidence"), F.min(rank).alias("best_rank"))
    return rank_rows(b, ["best_rank", batch], "batch_rank")


# AG-11 -----------------------------------------------------------------
def take_next_n(df: DataFrame, keys, order, n: str, marked: Column, row_id: str, cells=()) -> tuple[DataFrame, DataFrame]:
    """(groups, incomplete): from each marked row the next n rows of its key, the row included.

    Long form: start id, member position, member id. n is the row's own column and part of
    the key by choice of the caller. Rows meet by position, so a large key is no list.
    """
    keys = list(keys)
    d = number_rows(df, keys, order, "__rn", cells)
    starts = d.where(marked).select(*keys, F.col(row_id).alias("start_id"), "__rn", F.col(n).alias("__n")).where("__n > 0")
    want = starts.select(*keys, "start_id", "__n", F.posexplode(F.sequence(F.col("__rn"), F.col("__rn") + F.col("__n") - 1)).alias("member_index", "__rn"))
    got = want.join(d.select(*keys, "__rn", F.col(row_id).alias("member_id")), [*keys, "__rn"])
    full = got.groupBy(*keys, "start_id").agg(F.count(F.lit(1)).alias("__have"), F.first("__n").alias("__n"))
    ok = full.where("__have = __n").select(*keys, "start_id")
    bad = full.where("__have < __n").select(*keys, "start_id", F.col("__have").alias("found"), F.col("__n").alias("expected"))
    return got.join(ok, [*keys, "start_id"], "left_semi").drop("__rn", "__n"), bad


# AG-12 -----------------------------------------------------------------
def collect_members(df: DataFrame, keys, order, row_id: str, cells=()) -> DataFrame:
    """Members of each group in order, one row each, with the group's size."""
    from .scan import Fold, scan

    d = scan(df, keys, order, [Fold("member_index", "count"), Fold("__after", "rcount", inclusive=False)], cells)
    return d.select(*keys, "member_index", row_id, (F.col("member_index") + F.col("__after")).alias("members"))


def nest_members(members: DataFrame, keys, row_id: str, limit: int = 1024) -> DataFrame:
    """Lists of members for groups proven to hold at most `limit` rows; larger ones raise an error."""
    ok = F.when(F.col("members") <= limit, F.struct("member_index", row_id)).otherwise(
        F.raise_error(F.lit("group too large to nest; use its rows")).cast(f"struct<member_index:bigint,{row_id}:{members.schema[row_id].dataType.simpleString()}>"))
    return members.groupBy(*keys).agg(F.sort_array(F.collect_list(ok)).alias("m")).select(*keys, F.transform("m", lambda x: x[row_id]).alias("members"))


# AG-13 -----------------------------------------------------------------
def group_assets(df: DataFrame, asset: str, order, row_id: str, label: str, cells=()) -> tuple[DataFrame, DataFrame]:
    """(one row per asset with counts and distinct labels, its rows in order)."""
    head = df.groupBy(asset).agg(F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set(label)).alias("labels"), F.min(F.struct(*order)).alias("__first"))
    return head.drop("__first"), collect_members(df, [asset], order, row_id, cells)


# AG-14 -----------------------------------------------------------------
def page_model(assets: DataFrame, rows: DataFrame) -> DataFrame:
    """Page first: its review asset, its class assets, and how many rows still need review.

    assets: name, path; names are <page>__review_overlay or class_<page>__<class>_overlay.
    rows: page_id, status. The class map has one entry per class.
    """
    name = F.col("name")
    is_class = name.startswith("class_") & name.contains("__") & name.endswith("_overlay")
    body = F.regexp_replace(name, "^class_", "")
    page = F.when(is_class, F.split(body, "__", 2)[0]).when(~name.startswith("class_") & name.contains("__"), F.split(name, "__", 2)[0])
    cls = F.when(is_class, F.regexp_replace(F.split(body, "__", 2)[1], "_overlay$", ""))
    review = F.when(~name.startswith("class_") & (F.split(name, "__", 2)[1] == "review_overlay"), F.col("path"))
    a = assets.select(page.alias("page_id"), cls.alias("cls"), review.alias("rv"), "path").where("page_id is not null")
    m = a.groupBy("page_id").agg(
        F.max("rv").alias("review_overlay"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("cls").isNotNull(), F.struct("cls", "path"))))).alias("classes"))
    need = rows.where("page_id is not null and not status <=> 'matched'").groupBy("page_id").agg(F.count(F.lit(1)).alias("needs_review"))
    return m.join(need, "page_id", "left").fillna(0, ["needs_review"])


# AG-15 -----------------------------------------------------------------
def batch_summary(units: DataFrame, results: DataFrame, unit: str = "page_id") -> DataFrame:
    """Status per unit and counts per status; a unit without a result is failed, never dropped.

    results: unit, rows, error (NULL when it went well).
    """
    j = units.select(unit).join(results, unit, "left")
    s = F.when(F.col("error").isNotNull(), "failed").when(F.col("rows").isNull(), "missing").when(F.col("rows") == 0, "empty").otherwise("completed")
    return j.withColumn("status", s).groupBy("status").agg(F.count(F.lit(1)).alias("units"), F.sum(F.coalesce("rows", F.lit(0))).alias("rows"))
