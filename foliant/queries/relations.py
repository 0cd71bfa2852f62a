"""Queries over the star tables, as grids, references, runs and page geometry; and inspection over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import grid as G
from foliant.operators import html as H
from foliant.operators import lines as L
from foliant.operators import relations as R
from foliant.operators import urls


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem as sheets of cells: a supplier's sheet, rows by part, columns by quantity."""
    return _t(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sheet"), (F.col("l_partkey") % 500 + 1).alias("row"), F.col("l_quantity").cast("long").alias("col"), "l_orderkey", "l_linenumber", "l_returnflag", "l_tax"
    )


def column_letters(spark, sf):
    n = (F.col("o_orderkey") % 16384 + 1).alias("n")
    return _t(spark, sf, "orders").select("o_orderkey", n).select("o_orderkey", G.column_letters(F.col("n")).alias("letters"))


def a1_address(spark, sf):
    at = G.parse_address(G.address(F.col("o_orderkey") % 1048576 + 1, F.col("o_custkey") % 16384 + 1))
    return _t(spark, sf, "orders").select("o_orderkey", at["row"].alias("row"), at["col"].alias("col"))


def occupied_range(spark, sf):
    return G.occupied_range(_cells(spark, sf), ["sheet"])


def formula_counts(spark, sf):
    cells = _cells(spark, sf).withColumn("formula", F.when(F.col("l_returnflag") == "R", F.lit("A1+1")))
    return G.formula_counts(cells, ["sheet"])


def relationship_last_wins(spark, sf):
    rels = _t(spark, sf, "orders").select(F.col("o_custkey").alias("rid"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("target"))
    return R.last_wins(rels, ["rid"], "ord")


def relationship_ambiguity(spark, sf):
    return R.ambiguous(_t(spark, sf, "orders").select(F.col("o_custkey").alias("rid"), F.col("o_orderstatus").alias("type")), ["rid", "type"])


def reference_labels(spark, sf):
    refs = _t(spark, sf, "customer").select("c_custkey", F.upper("c_mktsegment").alias("label"))
    defs = _t(spark, sf, "customer").select(F.concat(F.lit(" "), F.col("c_mktsegment")).alias("label"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("target"))
    return R.by_label(refs, defs, "label", "ord").select("c_custkey", "target")


def merge_range_join(spark, sf):
    cells = _cells(spark, sf).select("sheet", "row", "col").distinct()
    areas = _t(spark, sf, "orders").select(
        (F.col("o_custkey") % 100 + 1).alias("sheet"), (F.col("o_orderkey") % 450 + 1).alias("top"), (F.col("o_orderkey") % 40 + 1).alias("left"), F.col("o_orderkey").alias("ord")
    )
    areas = areas.withColumns({"bottom": F.col("top") + F.col("ord") % 90, "right": F.col("left") + 9})
    return G.merged_cells(cells, areas, ["sheet"])


def readable_cells(spark, sf):
    """Every order as a native cell and as a shown value; every third and every fourth stand in columns of their own, where the other side is empty."""
    o = _t(spark, sf, "orders")
    state = F.when(F.col("o_orderkey") % 11 == 0, "error").when(F.col("o_orderkey") % 7 == 0, "missing").when(F.col("o_orderkey") % 5 == 0, "blank").otherwise("value")
    at = lambda n, col: [(F.col("o_orderkey") % 10).alias("sheet"), F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % n == 0, col).otherwise(1).alias("col")]
    native = o.select(*at(3, 2), F.col("o_orderstatus").alias("value"), state.alias("state"))
    return G.readable_cells(native, o.select(*at(4, 3), F.col("o_orderpriority").alias("value")), ["sheet"]).select("sheet", "row", "col", "text")


def addressed_grid(spark, sf):
    return G.addressed_rows(_cells(spark, sf).groupBy("sheet", "row", "col").agg(F.min("l_returnflag").alias("text")), ["sheet"])


def repeat_expansion(spark, sf):
    runs = _t(spark, sf, "orders").select(
        "o_orderkey", F.lit(1).cast("long").alias("row"), F.lit(1).cast("long").alias("col"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("value"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("row_repeat"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("col_repeat"),
    )
    return G.expand_repeats(runs).select("o_orderkey", "row", "col", "value", "kind")


def shared_formulas(spark, sf):
    """All orders as sheets of 2,000 rows; the first twenty rows of a sheet are its masters."""
    row = F.col("o_orderkey") % 2000 + 1
    cells = _t(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 2000).alias("sheet"), (row % 20).alias("shared"), row.alias("row"), F.lit(3).cast("long").alias("col"),
        F.when(row <= 20, F.concat(F.lit("SUM(A"), row.cast("string"), F.lit(":$B$1)+C1"))).alias("formula"),
    )
    return G.shared_formulas(cells, ["sheet"]).select("sheet", "row", "formula")


def inherited_attributes(spark, sf):
    """The page tree over all orders, under order 0; a path has as many levels as its id has digits to base 4, and the root."""
    ids = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus")).alias("rotation"))
    digits = "cast(if(id = 0, 0, ceil(length(bin(id)) / 2)) as int)"
    return R.inherited(ids.withColumn("path", F.expr(f"transform(sequence({digits}, 0, -1), k -> shiftright(id, 2 * k))")), "rotation").select("id", "rotation")


def fallback_chain(spark, sf):
    part = _t(spark, sf, "part")
    items = part.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") > 25).alias("usable"), F.when(F.col("p_partkey") % 9 != 0, (F.col("p_partkey") * 7) % max(part.count(), 1) + 1).alias("fallback")
    )
    return R.fallback_chain(spark, items)


def xref_versions(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("object_id"), F.struct((-F.col("l_orderkey")).alias("revision"), "l_linenumber", "l_suppkey").alias("precedence"), "l_orderkey")
    return R.versions(rows, ["object_id"], "precedence").select("object_id", F.col("l_orderkey").alias("revision"))


def multiset_anti_join(spark, sf):
    items = _t(spark, sf, "lineitem").select("l_partkey", "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("at"), "l_returnflag", "l_orderkey", "l_linenumber")
    return R.multiset_anti(items.where("l_returnflag = 'N'"), items.where("l_returnflag <> 'N'"), ["l_partkey", "l_quantity"], "at").select("l_orderkey", "l_linenumber")


def field_pairs(spark, sf):
    tokens = _t(spark, sf, "conversations").select(
        "conv_id", F.explode(F.array(F.struct((F.col("turn") * 2).alias("pos"), F.lit("begin").alias("kind")), F.struct((F.col("turn") * 2 + 1).alias("pos"), F.when(F.col("turn") % 2 == 0, "begin").otherwise("end").alias("kind")))).alias("t")
    ).select("conv_id", "t.pos", "t.kind")
    return R.paired(tokens, ["conv_id"], "pos", "kind", "begin", "end")


def longest_run(spark, sf):
    flags = _t(spark, sf, "events").select("user_id", "event_id", (F.col("value") > 10).alias("flag"))
    return L.longest_run(flags, ["user_id"], "event_id", "flag")


def band_split(spark, sf):
    lines = _t(spark, sf, "events").select("user_id", F.col("event_id").alias("top"), (F.col("event_id") + 1).alias("bottom"))
    return L.bands(lines, ["user_id"], "top", "bottom").groupBy("user_id").agg((F.max("band") + 1).alias("bands"))


def gutter_histogram(spark, sf):
    """Sixty bins over each sheet's width, as the gutter search counts characters."""
    c = _cells(spark, sf)
    span = c.groupBy("sheet").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    bin_no = F.least(F.floor((F.col("col") - F.col("lo")) * 60 / (F.col("hi") - F.col("lo") + 1)), F.lit(59))
    return c.join(span, "sheet").groupBy("sheet", bin_no.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def median_gap(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    gaps = _t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") - F.lag("l_orderkey").over(w)).cast("double").alias("gap"))
    return gaps.groupBy("l_suppkey").agg(F.median("gap").alias("median_gap"))


def public_addresses(spark, sf):
    ip = F.concat_ws(".", (F.col("o_orderkey") % 256).cast("string"), (F.col("o_custkey") % 256).cast("string"), F.lit("0"), F.lit("1"))
    return _t(spark, sf, "orders").select("o_orderkey", urls.is_public_v4(ip).alias("public"))


def _findings(spark, sf) -> DataFrame:
    nodes = H.html_nodes(_t(spark, sf, "pages").select("page_id", "html"))
    tag = F.col("tag")
    capability = (
        F.when((tag == "a") & F.col("attrs")["href"].isNotNull(), "links").when(tag == "img", "images").when(tag == "script", "scripts").when(tag == "style", "styles")
        .when(tag.isin("form", "input"), "forms").when(tag == "meta", "metadata").when(tag == "comment", "comments")
    )
    return nodes.select("source_id", "pre", capability.alias("capability")).where("capability is not null")


def html_findings(spark, sf):
    w = Window.partitionBy("source_id").orderBy("pre")
    return _findings(spark, sf).select(F.col("source_id").alias("page_id"), F.format_string("f%06d", F.row_number().over(w)).alias("finding_id"), "capability")


def evidence_grid(spark, sf):
    docs = _t(spark, sf, "pages").select(F.col("page_id").alias("source_id"))
    return R.evidence_grid(docs, _findings(spark, sf)).withColumnRenamed("source_id", "page_id")


def coverage_rollup(spark, sf):
    docs = _t(spark, sf, "pages").select(F.col("page_id").alias("source_id"))
    status = F.when(F.col("findings") > 0, "complete").otherwise("not_applicable")
    return R.coverage_rollup(R.evidence_grid(docs, _findings(spark, sf)).withColumn("status", status)).withColumnRenamed("source_id", "page_id")


def coverage_fold(spark, sf):
    """Events as coverage events of users: purchases recover, errors fail."""
    e = _t(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("status"), (F.col("value") > 40).alias("failed"), (F.col("value") < 1).alias("recovered"), F.when(F.col("value") > 40, F.col("event_type")).alias("reason")
    )
    return R.fold_coverage(e, ["user_id"])


_CELLS = "SELECT l_suppkey AS sheet, l_partkey % 500 + 1 AS row, l_quantity::BIGINT AS col, l_returnflag FROM lineitem"
_LETTERS = """CASE WHEN {c} <= 26 THEN chr((64 + {c})::INT) WHEN {c} <= 702 THEN chr((65 + (({c} - 1) // 26 - 1) % 26)::INT) || chr((65 + ({c} - 1) % 26)::INT)
 ELSE chr((64 + ({c} - 27) // 676)::INT) || chr((65 + (({c} - 1) // 26 - 1) % 26)::INT) || chr((65 + ({c} - 1) % 26)::INT) END"""
_COUNTS = r"""SELECT page_id, 'links' AS capability, len(regexp_extract_all(html, '<a href'))::BIGINT AS n FROM pages UNION ALL SELECT page_id, 'scripts', len(regexp_extract_all(html, '<script'))::BIGINT FROM pages
 UNION ALL SELECT page_id, 'styles', len(regexp_extract_all(html, '<style'))::BIGINT FROM pages UNION ALL SELECT page_id, 'metadata', len(regexp_extract_all(html, '<meta'))::BIGINT FROM pages
 UNION ALL SELECT page_id, 'comments', len(regexp_extract_all(html, '<!--'))::BIGINT FROM pages"""
_GRID = f"""SELECT p.page_id, c.capability, coalesce(k.n, 0)::BIGINT AS findings FROM pages p CROSS JOIN (SELECT unnest([{', '.join(repr(c) for c in R.CAPABILITIES)}]) AS capability) c
 LEFT JOIN ({_COUNTS}) k ON k.page_id = p.page_id AND k.capability = c.capability"""

QUERIES = {
    "column_letters": (column_letters, f"SELECT o_orderkey, {_LETTERS.format(c='(o_orderkey % 16384 + 1)')} AS letters FROM orders"),
    "a1_address": (a1_address, "SELECT o_orderkey, o_orderkey % 1048576 + 1 AS row, o_custkey % 16384 + 1 AS col FROM orders"),
    "occupied_range": (
        occupied_range,
        f"""SELECT sheet, "top", "left", bottom, "right", {_LETTERS.format(c='"left"')} || "top" || ':' || {_LETTERS.format(c='"right"')} || bottom AS range FROM (
 SELECT sheet, min(row) AS "top", min(col) AS "left", max(row) AS bottom, max(col) AS "right" FROM ({_CELLS}) GROUP BY sheet)""",
    ),
    "merge_range_join": (
        merge_range_join,
        f"""SELECT c.sheet, c.row, c.col, min(a.ord) AS merge_ord FROM (SELECT DISTINCT sheet, row, col FROM ({_CELLS})) c JOIN (SELECT o_custkey % 100 + 1 AS sheet, o_orderkey % 450 + 1 AS t, o_orderkey % 40 + 1 AS l,
 o_orderkey AS ord FROM orders) a ON a.sheet = c.sheet AND c.row BETWEEN t AND t + ord % 90 AND c.col BETWEEN l AND l + 9 GROUP BY ALL""",
    ),
    "readable_cells": (
        readable_cells,
        """WITH n AS (SELECT o_orderkey % 10 AS sheet, o_orderkey AS row, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS col, o_orderstatus AS v,
 CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'blank' ELSE 'value' END AS state FROM orders),
 s AS (SELECT o_orderkey % 10 AS sheet, o_orderkey AS row, CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 1 END AS col, o_orderpriority AS shown FROM orders)
 SELECT sheet, row, col, CASE WHEN state = 'error' THEN v WHEN state = 'missing' THEN '[missing cached result]' WHEN shown IS NOT NULL THEN shown WHEN state = 'blank' THEN '[blank]' ELSE v END AS text
 FROM n FULL JOIN s USING (sheet, row, col)""",
    ),
    "addressed_grid": (
        addressed_grid,
        f"""SELECT sheet, row, '| ' || row || ' | ' || string_agg({_LETTERS.format(c='col')} || row || ': ' || t, ' | ' ORDER BY col) || ' |' AS line FROM (
 SELECT sheet, row, col, min(l_returnflag) AS t FROM ({_CELLS}) GROUP BY ALL) GROUP BY sheet, row""",
    ),
    "repeat_expansion": (
        repeat_expansion,
        """SELECT o_orderkey, 1 + r AS row, 1 + c AS col, o_orderstatus AS value, 'cell' AS kind FROM (SELECT o_orderkey, o_orderstatus, r, unnest(range(0, o_orderkey % 3 + 1)) AS c FROM (
 SELECT o_orderkey, o_orderstatus, unnest(range(0, o_orderkey % 4 + 1)) AS r FROM orders WHERE o_orderkey % 3 <> 0))
 UNION ALL SELECT o_orderkey, 1, 1, NULL, 'blank-range' FROM orders WHERE o_orderkey % 3 = 0""",
    ),
    "formula_counts": (formula_counts, f"SELECT sheet, count(*) AS formulas FROM ({_CELLS}) WHERE l_returnflag = 'R' GROUP BY sheet"),
    "shared_formulas": (
        shared_formulas,
        """WITH c AS (SELECT o_orderkey // 2000 AS sheet, o_orderkey % 2000 + 1 AS row FROM orders)
 SELECT f.sheet, f.row, 'SUM(A' || f.row || ':$B$1)+C' || (1 + f.row - m.row) AS formula FROM c f JOIN c m ON m.sheet = f.sheet AND m.row <= 20 AND m.row % 20 = f.row % 20""",
    ),
    "relationship_last_wins": (relationship_last_wins, "SELECT o_custkey AS rid, max(o_orderkey) AS ord, arg_max(o_orderpriority, o_orderkey) AS target FROM orders GROUP BY o_custkey"),
    "relationship_ambiguity": (relationship_ambiguity, "SELECT o_custkey AS rid, o_orderstatus AS type, count(*) AS matches FROM orders GROUP BY ALL HAVING count(*) <> 1"),
    "reference_labels": (
        reference_labels,
        "SELECT c.c_custkey, d.t AS target FROM customer c LEFT JOIN (SELECT lower(c_mktsegment) AS k, arg_min(c_name, c_custkey) AS t FROM customer GROUP BY 1) d ON d.k = lower(c.c_mktsegment)",
    ),
    "inherited_attributes": (
        inherited_attributes,
        """WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus END AS v FROM orders),
 up AS (SELECT id, id // (4 ** unnest(range(0, 31)))::BIGINT AS above FROM n)
 SELECT n.id, arg_max(u.v, u.id) AS rotation FROM n LEFT JOIN (SELECT up.id AS below, w.id, w.v FROM up JOIN n w ON w.id = up.above AND w.v IS NOT NULL) u ON u.below = n.id GROUP BY n.id""",
    ),
    "fallback_chain": (
        fallback_chain,
        """WITH RECURSIVE i AS (SELECT p_partkey AS id, p_size > 25 AS usable, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey * 7) % (SELECT count(*) FROM part) + 1 END AS nx FROM part),
 c(id, cur, usable, nx, path) AS (SELECT id, id, usable, nx, [id] FROM i UNION ALL SELECT c.id, i.id, i.usable, i.nx, list_append(c.path, i.id) FROM c JOIN i ON i.id = c.nx
 WHERE NOT c.usable AND NOT list_contains(c.path, i.id)) SELECT id, max(CASE WHEN usable THEN cur END) AS target FROM c GROUP BY id""",
    ),
    "xref_versions": (xref_versions, "SELECT l_partkey AS object_id, max(l_orderkey) AS revision FROM lineitem GROUP BY l_partkey"),
    "multiset_anti_join": (
        multiset_anti_join,
        """WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity, l_returnflag = 'N' ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem)
 SELECT l_orderkey, l_linenumber FROM x WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM x y WHERE y.l_returnflag <> 'N' AND y.l_partkey = x.l_partkey AND y.l_quantity = x.l_quantity AND y.k = x.k)""",
    ),
    "field_pairs": (
        field_pairs,
        """SELECT conv_id, depth, turn * 2 AS "begin", turn * 2 + 1 AS "end" FROM (
 SELECT conv_id, turn, (sum(CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) + 1)::BIGINT AS depth FROM conversations) WHERE turn % 2 = 1""",
    ),
    "longest_run": (
        longest_run,
        """WITH n AS (SELECT user_id, value > 10 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 g AS (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS i FROM n WHERE f), r AS (SELECT user_id, min(k) AS start, count(*) AS length FROM g GROUP BY user_id, i)
 SELECT user_id, start, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS p FROM r) WHERE p = 1""",
    ),
    "band_split": (
        band_split,
        """WITH g AS (SELECT user_id, event_id, event_id - lag(event_id + 1) OVER w AS gap, event_id - lag(event_id) OVER w AS pitch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 m AS (SELECT user_id, median(pitch) AS m FROM g GROUP BY user_id) SELECT user_id, (1 + count(*) FILTER (gap > 1.6 * m))::BIGINT AS bands FROM g JOIN m USING (user_id) GROUP BY user_id""",
    ),
    "gutter_histogram": (
        gutter_histogram,
        f"""WITH c AS ({_CELLS}), s AS (SELECT sheet, min(col) AS lo, max(col) AS hi FROM c GROUP BY sheet)
 SELECT sheet, least((col - lo) * 60 // (hi - lo + 1), 59)::BIGINT AS bin, count(*) AS n FROM c JOIN s USING (sheet) GROUP BY ALL""",
    ),
    "median_gap": (
        median_gap,
        "SELECT l_suppkey, median(gap)::DOUBLE AS median_gap FROM (SELECT l_suppkey, l_orderkey - lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS gap FROM lineitem) GROUP BY 1",
    ),
    "public_addresses": (
        public_addresses,
        """SELECT o_orderkey, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168))
 OR (a = 198 AND b IN (18, 19))) AS public FROM (SELECT o_orderkey, o_orderkey % 256 AS a, o_custkey % 256 AS b FROM orders)""",
    ),
    "html_findings": (html_findings, None),
    "evidence_grid": (evidence_grid, _GRID),
    "coverage_rollup": (
        coverage_rollup,
        f"""SELECT page_id, count(*) FILTER (findings > 0) AS complete, 0::BIGINT AS partial, 0::BIGINT AS unavailable, count(*) FILTER (findings = 0) AS not_applicable FROM ({_GRID}) GROUP BY page_id""",
    ),
    "coverage_fold": (
        coverage_fold,
        """SELECT user_id, CASE WHEN bool_or(value > 40) AND bool_or(value < 1) THEN 'partial' WHEN bool_or(value > 40) THEN 'unavailable' ELSE arg_max(event_type, event_id) END AS status,
 coalesce(string_agg(event_type, '; ' ORDER BY event_id) FILTER (value > 40), '') AS reason FROM events GROUP BY user_id""",
    ),
}
