"""Preparation of data sets: matching, grouping, splits, trees, intervals, tables in HTML."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions import text as tx
from orrery.session import staged, text_batches


def one_to_one(entities: DataFrame, cells: DataFrame, by: list[str], entity_order: str, cell_order: str) -> DataFrame:
    """Gives the k-th entity of a value the k-th cell of that value.

    status: exact (the only cell), ambiguous (one of several), reused (the first
    cell again, when there are fewer cells than entities) or unmatched.
    """
    e = entities.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(entity_order)))
    c = cells.select(*by, F.col(cell_order).alias("cell"), F.row_number().over(W.partitionBy(*by).orderBy(cell_order)).alias("_k"))
    n = cells.groupBy(*by).agg(F.count("*").alias("n_cells"), F.min(cell_order).alias("_first"))
    rows = e.join(n, by, "left").join(c, [*by, "_k"], "left")
    status = F.when(F.col("n_cells").isNull(), "unmatched").when(F.col("cell").isNull(), "reused").when(F.col("n_cells") == 1, "exact").otherwise("ambiguous")
    return rows.withColumn("status", status).withColumn("cell", F.coalesce("cell", "_first")).drop("_k", "_first")


def gold_lookup(entities: DataFrame, gold: DataFrame, by: list[str], value: str) -> DataFrame:
    """``entities`` with golds, the distinct ``value`` of all gold rows of equal ``by``, and n_golds;
    a pair may have several, or none."""
    sets = gold.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("golds"))
    return entities.join(sets, by, "left").withColumn("n_golds", F.coalesce(F.size("golds"), F.lit(0)).cast("long"))


def by_rules(text: Column, rules: list[tuple[str, str, str]], default: str) -> Column:
    """The label of the first of ``rules`` (how, pattern, label) that a text meets; how is prefix, suffix, inside or pattern."""
    meets = {"prefix": lambda p: text.startswith(p), "suffix": lambda p: text.endswith(p), "inside": lambda p: text.contains(p), "pattern": lambda p: text.rlike(p)}
    out = F.lit(None).cast("string")
    for how, pattern, label in reversed(rules):
        out = F.when(meets[how](pattern), label).otherwise(out)
    return F.coalesce(out, F.lit(default))


def ordered_unique(order: str, value: str) -> Column:
    """Aggregate: the distinct values of a group in the order of their first place."""
    return F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]))


def duplicate_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """groups of equal keys with more than one row, rows beyond the first of each, and rows in all."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.count(F.when(F.col("n") > 1, 1)).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("extra"), F.sum("n").alias("rows"))


def split_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both tables, and in either alone."""
    both = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(count(F.col("_a") & F.col("_b")).alias("shared"), count(F.col("_b").isNull()).alias("only_a"), count(F.col("_a").isNull()).alias("only_b"))


def interval_overlap(a: DataFrame, b: DataFrame, on: str, width: int) -> DataFrame:
    """Pairs of intervals [start, end) of ``a`` and [other_start, other_end) of ``b`` with the same ``on`` that overlap.

    Both sides are cut into bins of ``width`` and meet on (on, bin), so only
    neighbours are compared; a pair counts in the first bin that both share.
    """
    def binned(df, start, end):
        last = F.greatest(F.col(start), F.col(end) - 1)
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))

    rows = binned(a, "start", "end").join(binned(b, "other_start", "other_end"), [on, "_bin"])
    meet = (F.col("start") < F.col("other_end")) & (F.col("end") > F.col("other_start"))
    return rows.where(meet & (F.col("_bin") == F.floor(F.greatest("start", "other_start") / width))).drop("_bin")


def tree_paths(nodes: DataFrame, notes: str | None = None) -> DataFrame:
    """node, path, depth of a parent table (node, parent, name), level by level until no
    node is added; with ``notes``, an array column, also the lists of all nodes above, the
    highest first, then the own one.

    Every level is written once, so a deep tree does not lengthen the plan.  Raises where
    nodes are their own ancestors.  Nodes whose parent is missing have no path.
    """
    own = [F.coalesce(F.col(notes), F.array().cast(nodes.schema[notes].dataType)).alias(notes)] if notes else []
    at = staged(nodes.where("parent is null").select("node", F.col("name").alias("path"), F.lit(0).alias("depth"), *own), "level")
    found, depth, below = at, 0, nodes.where("parent is not null")
    total = nodes.count()
    while not at.isEmpty():
        depth += 1
        if depth > total:
            raise ValueError("the tree has a cycle")
        up = at.select(F.col("node").alias("parent"), F.col("path").alias("_p"), *([F.col(notes).alias("_n")] if notes else []))
        inherited = [F.concat("_n", *own).alias(notes)] if notes else []
        at = staged(below.join(up, "parent").select("node", F.concat_ws(" > ", "_p", "name").alias("path"), F.lit(depth).alias("depth"), *inherited), "level")
        found = found.unionByName(at)
    return found


class _Cells(HTMLParser):
    """Rows of (table, row, column, text) with column spans filled out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.table, self.row, self.col, self.cell, self.span, self.found = -1, -1, 0, None, 1, []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self._close()
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th"):
            self._close()
            span = dict(attrs).get("colspan") or "1"
            self.cell, self.span = [], max(1, min(int(span) if span.isdigit() else 1, 1000))

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None:
            text = " ".join("".join(self.cell).split())
            for _ in range(self.span):
                self.found.append((self.table, self.row, self.col, text))
                self.col += 1
            self.cell = None


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, row, col, cell of all tables in HTML texts; null texts have none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, cells = [], []
            for k, text in zip(b.column(key).to_pylist(), b.column(html).to_pylist()):
                p = _Cells()
                p.feed(text or "")
                p._close()
                keys += [k] * len(p.found)
                cells += p.found
            cols = list(zip(*cells)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(key).type), *(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[key, "table", "row", "col", "cell"])

    return text_batches(pages.select(key, html)).mapInArrow(run, f"{key} {kind}, table int, row int, col int, cell string")


def table_context(cells: DataFrame, by: list[str]) -> DataFrame:
    """``by``, row, col, cell, number, row_context, column_context of every number in a table of cells.

    The row's context is the lone label of each of the three rows above that has no
    number, and the nearest label to the left.  The column's is, of each row above, the
    header at the number's place among the numbers of its row, or the only header if
    it names a period; the last four of them.  A first header that names a unit is skipped
    where headers outnumber numbers.  A table is one row of arrays while this is done.
    """
    t = tx.once(F.col("cell"))
    number, filled = tx.dataset_number(t), (t != "") & ~t.isin(*tx.UNIT_CELLS)
    roles = cells.withColumn("_shown", t).withColumn("number", F.when(filled, number).otherwise("")).withColumn("period", t.rlike(tx.PERIOD))
    plain = filled & (F.col("number") == "") & ~t.rlike(tx.UNIT)
    roles = roles.withColumn("label", plain).withColumn("header", filled & (F.col("period") | plain))
    ordered = F.array_sort(F.collect_list(F.struct("col", F.col("_shown").alias("t"), "number", "label", "header", "period")))
    rows = roles.groupBy(*by, "row").agg(ordered.alias("cells"))
    rows = rows.select(*by, "row", *[F.filter("cells", f).alias(n) for n, f in (("labels", lambda x: x["label"]), ("headers", lambda x: x["header"]), ("numbers", lambda x: x["number"] != ""))])
    tables = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row", "labels", "headers", "numbers"))).alias("rows"))
    each = tables.select(*by, "rows", F.explode("rows").alias("r")).select(*by, "rows", "r", F.posexplode("r.numbers").alias("nth", "n"))
    here, above = F.col("r.row"), F.filter("rows", lambda x: x["row"] < F.col("r.row"))
    sections = F.transform(F.filter(above, lambda x: (x["row"] >= here - 3) & (F.size(x["labels"]) == 1) & (F.size(x["numbers"]) == 0)), lambda x: F.get(x["labels"], F.lit(0))["t"])
    left = F.filter("r.labels", lambda x: x["col"] < F.col("n.col"))
    nearest = F.when(F.size(left) > 0, F.array(F.element_at(left, -1)["t"])).otherwise(F.array().cast("array<string>"))

    def piece(x):
        h, n = x["headers"], F.size("r.numbers")
        skip = F.when((F.size(h) > n) & F.lower(F.get(h, F.lit(0))["t"]).rlike(r"\b(in millions|in thousands|dollars|shares|except)\b"), 1).otherwise(0)
        return F.when(F.size(h) == 1, F.when(F.get(h, F.lit(0))["period"], F.get(h, F.lit(0))["t"])).otherwise(F.get(h, F.least(F.col("nth") + skip, F.size(h) - 1))["t"])

    pieces = F.filter(F.transform(F.filter(above, lambda x: F.size(x["headers"]) > 0), piece), lambda x: x.isNotNull())
    last = F.slice(pieces, F.greatest(F.size(pieces) - 3, F.lit(1)), F.lit(4))
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(F.array_distinct(a), " | "))
    return each.select(*by, here.alias("row"), F.col("n.col").alias("col"), F.col("n.t").alias("cell"), F.col("n.number").alias("number"), joined(F.concat(sections, nearest)).alias("row_context"), joined(last).alias("column_context"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)


def visible_text(html: str | None) -> str:
    """The text nodes of HTML with white space squeezed; script and style contents count as text.

    A text without a tag only has its character references resolved.  What comes after
    the last whole tag or reference at the end of a page that is cut off is not read; where nothing
    is left, tags are taken out by their brackets instead.
    """
    text = html or ""
    if "<" not in text or ">" not in text:
        return " ".join(unescape(text).split())
    p = _Text()
    p.feed(text)  # not closed: the parser would take a cut-off tag for text
    return " ".join(" ".join(p.parts).split()) or " ".join(re.sub("<[^>]+>", " ", unescape(text)).split())


def html_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([visible_text(t) for t in b.column(html).to_pylist()], pa.string())], names=[key, "text"])

    return text_batches(pages.select(key, html)).mapInArrow(run, f"{key} {kind}, text string")


def bipartite_size(a: list[str], b: list[str], alike) -> int:
    """The size of the largest one-to-one matching between two lists."""
    match: dict[int, int] = {}

    def place(i, seen):
        for j in range(len(b)):
            if j not in seen and alike(a[i], b[j]):
                seen.add(j)
                if j not in match or place(match[j], seen):
                    match[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


def relaxed_contexts(a: str, b: str, threshold: float) -> bool:
    """Equal, one inside the other, or alike by their distinct words and numbers."""
    x, y = " ".join(a.lower().split()), " ".join(b.lower().split())
    if x == y or (x and y and (x in y or y in x)):
        return True
    s, t = (set(re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", v)) for v in (x, y))
    return (len(s & t) / len(s | t) if s | t else 1.0) >= threshold


def bipartite_match(rows: DataFrame, key: str, left: str, right: str, threshold: float) -> DataFrame:
    """key, matched for rows with two arrays of texts, matched at most once each."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            sizes = [bipartite_size(x or [], y or [], lambda s, t: relaxed_contexts(s, t, threshold)) for x, y in zip(b.column(left).to_pylist(), b.column(right).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(sizes, pa.int64())], names=[key, "matched"])

    return rows.select(key, left, right).mapInArrow(run, f"{key} {kind}, matched long")
