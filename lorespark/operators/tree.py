"""The parent forest: ancestors, breadcrumbs, pre-order, descendants, cycle checks.

Positions are numbers, found by pointer doubling with weights: each round joins
every page to the one it points at, takes over that one's pointer and adds its
weight, so a forest of depth d needs log2(d) rounds over rows of fixed size. Going
up, weights of one give the depth; what pages hand to those they point at adds up
to subtree sizes; and one more climb, over the sizes of earlier siblings, gives
places in pre-order. A subtree is then an interval. Only pages that are parents
take part in the rounds; their children look the result up once.

Breadcrumbs are lists by nature, and only they are built as chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage, release, written
from .filters import active, with_status
from .scale import sum_before


def chains(nodes: DataFrame, label: Column | None = None) -> DataFrame:
    """(id, chain, cyclic): ancestors of every node from the nearest to the root.

    `nodes` has (id, parent_id). A parent that is not among the nodes ends the
    chain. `cyclic` marks nodes whose chain never ends. Each chain entry is a
    struct of the ancestor's id and, if given, its label.
    """
    entry = F.struct(F.col("id").alias("id"), (label if label is not None else F.lit(None).cast("string")).alias("label"))
    base = nodes.select("id", "parent_id", entry.alias("_self"))
    parents = base.select(F.col("parent_id").alias("id")).filter(F.col("id").isNotNull()).distinct()
    inner = base.join(parents, "id", "left_semi")
    state = inner.join(
        inner.select(F.col("id").alias("parent_id"), F.col("_self").alias("_parent")), "parent_id", "left"
    ).select(
        "id",
        F.when(F.col("_parent").isNotNull(), F.array("_parent")).otherwise(F.array().cast(_array_of(base))).alias("chain"),
        F.when(F.col("_parent").isNotNull(), F.col("parent_id")).alias("next"),
        F.lit(False).alias("cyclic"),
        F.col("_self"),
    )
    state = cut_lineage(state)
    while state.filter(F.col("next").isNotNull()).limit(1).count():
        step = state.select(F.col("id").alias("next"), F.col("chain").alias("_chain"), F.col("next").alias("_next"), F.col("cyclic").alias("_cyclic"))
        joined = state.join(step, "next", "left")
        longer = F.when(F.col("next").isNull(), F.col("chain")).otherwise(F.concat("chain", F.col("_chain")))
        grown = joined.select("id", longer.alias("chain"), F.col("_next").alias("next"), (F.col("cyclic") | F.coalesce("_cyclic", F.lit(False))).alias("cyclic"), "_self")
        # A chain that meets its own page, or any page twice, runs in a circle.
        repeated = F.size(F.array_distinct(F.transform("chain", lambda item: item["id"]))) < F.size("chain")
        circle = repeated | F.exists("chain", lambda item: item["id"] == F.col("id"))
        state = cut_lineage(grown.withColumn("cyclic", F.col("cyclic") | circle).withColumn("next", F.when(~F.col("cyclic"), F.col("next"))))
    lookup = state.select(F.col("id").alias("parent_id"), F.concat(F.array("_self"), F.col("chain")).alias("chain"), "cyclic")
    all_nodes = base.join(lookup, "parent_id", "left")
    return all_nodes.select(
        "id",
        F.coalesce("chain", F.array().cast(_array_of(base))).alias("chain"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )


def _array_of(base: DataFrame) -> str:
    return f"array<{base.schema['_self'].dataType.simpleString()}>"


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """(id, breadcrumbs): live ancestors from the root down to the parent.

    The walk stops at a deleted page and before the first page seen twice.
    """
    live = active(pages)
    walked = chains(live.select("id", "parent_id", "title"), F.col("title"))
    ids = F.transform("chain", lambda item: item["id"])
    upto = F.filter(F.col("chain"), lambda item, position: ~F.array_contains(F.slice(ids, F.lit(1), position), item["id"]))
    return walked.select("id", F.reverse(F.when(F.col("cyclic"), upto).otherwise(F.col("chain"))).alias("breadcrumbs"))


def climbed(nodes: DataFrame) -> DataFrame:
    """(id, root, total, size, next): what pointer doubling gathers over `nodes` (id, parent_id, total, size).

    `total` becomes the sum of `total` over a page and its ancestors, `size` the
    sum of `size` over a page and its descendants. A parent must be among the nodes
    or null. `next` stays set for pages in circles or below one, whose other values
    mean nothing.
    """
    state, open_rows = _counted(nodes.select("id", F.col("parent_id").alias("next"), F.col("id").alias("root"), F.col("total").cast("long").alias("total"), F.col("size").cast("long").alias("size")))
    before = -1
    # A round that settles no page settles none ever after: what is left runs in circles.
    while open_rows and open_rows != before:
        target = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("root").alias("_root"), F.col("total").alias("_total"))
        handed = state.filter("next is not null").groupBy(F.col("next").alias("id")).agg(F.sum("size").alias("_more"))
        zero = F.lit(0).cast("long")
        grown = state.join(target, "next", "left").join(handed, "id", "left").select(
            "id", F.col("_next").alias("next"), F.coalesce("_root", "root").alias("root"), (F.col("total") + F.coalesce("_total", zero)).alias("total"), (F.col("size") + F.coalesce("_more", zero)).alias("size")
        )
        before = open_rows
        after, open_rows = _counted(grown)
        release(state)
        state = after
    return state


def _counted(state: DataFrame) -> tuple[DataFrame, int]:
    """The state as a table, and how many of its rows still point at another page: counted as they are written."""
    seen = Observation()
    table = written(state.observe(seen, F.count_if(F.col("next").isNotNull()).alias("open")))
    return table, seen.get["open"]


def _linked(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose parent is null unless it is one of them, and those of them that are parents."""
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    linked = nodes.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("_known"), F.col("parent_id"))).drop("_known")
    return linked, linked.join(linked.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("_children")).withColumnRenamed("parent_id", "id"), "id")


def positions(nodes: DataFrame) -> DataFrame:
    """(id, root, depth, place, size, cyclic) of `nodes` (id, parent_id, label), one row each.

    `place` counts from 0 at the root in pre-order, siblings by label and id; a
    page's subtree has the places from its own on, `size` of them, under its root.
    A parent that is not among the nodes ends the tree.
    """
    linked = written(_linked(nodes.filter("id is not null").select("id", "parent_id", "label"))[0])
    inner = _linked(linked)[1]
    inside = inner.select("id", F.lit(True).alias("_inner"))
    marked = linked.join(inside, "id", "left")
    leaves = marked.filter("_inner is null and parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("_leaves"))
    sized = inner.join(leaves, "id", "left").select("id", "parent_id", F.col("parent_id").isNotNull().cast("long").alias("total"), (F.lit(1) + F.coalesce("_leaves", F.lit(0))).alias("size"))
    up = climbed(sized).select("id", "root", F.col("total").alias("depth"), "size", F.col("next").isNotNull().alias("cyclic"))

    one = F.lit(1).cast("long")
    rows = linked.join(up, "id", "left").withColumn("size", F.when(F.coalesce("cyclic", F.lit(False)), one).otherwise(F.coalesce("size", one)))
    stepped = sum_before(rows.filter("parent_id is not null").select("id", "parent_id", "label", "size"), "parent_id", ["label", "id"], "size", "_before")
    steps = written(rows.join(stepped.select("id", (F.col("_before") + 1).alias("step")), "id", "left").select("id", "parent_id", "root", "depth", "size", "cyclic", F.coalesce("step", F.lit(0)).alias("step")))
    places = climbed(steps.join(inside, "id", "left_semi").select("id", "parent_id", F.col("step").alias("total"), F.lit(0).alias("size"))).select("id", F.col("total").alias("place"))
    above = up.select(F.col("id").alias("parent_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("cyclic").alias("_cyclic")).join(places.select(F.col("id").alias("parent_id"), F.col("place").alias("_place")), "parent_id")
    found = steps.join(above, "parent_id", "left").join(places, "id", "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "id", F.coalesce("root", "_root", "id").alias("root"), F.coalesce("depth", F.col("_depth") + 1, zero).alias("depth"), F.coalesce("place", F.col("_place") + F.col("step"), zero).alias("place"), "size",
        F.coalesce("cyclic", "_cyclic", F.lit(False)).alias("cyclic"),
    )


def forest(pages: DataFrame) -> DataFrame:
    """Positions of all live pages."""
    return positions(active(pages).select("id", "parent_id", F.lower("title").alias("label")))


def write_forest(pages: DataFrame, folder: str) -> None:
    """Positions as a table sorted by tree and place: a subtree is then a few row groups."""
    forest(pages).repartitionByRange("root", "place").sortWithinPartitions("root", "place").write.mode("overwrite").parquet(folder)


def tree(pages: DataFrame, status: str = "published") -> DataFrame:
    """Pages in pre-order with depth: (id, title, alias, status, parent_id, depth, root_id, place, size).

    Siblings are ordered by title without case, then id. A page whose parent is
    not shown becomes a root; pages in circles are left out.
    """
    shown = with_status(active(pages), status)
    label = F.lower("title")
    walked = positions(shown.select("id", "parent_id", label.alias("label"))).filter(~F.col("cyclic")).drop("cyclic")
    roots = shown.select(F.col("id").alias("root"), label.alias("_root_label"))
    rows = shown.select("id", "title", "alias", "status", "parent_id").join(walked, "id").join(roots, "root")
    return rows.orderBy("_root_label", "root", "place").select("id", "title", "alias", "status", "parent_id", "depth", F.col("root").alias("root_id"), "place", "size")


def descendants(pages: DataFrame, page_id: int, known: DataFrame | None = None) -> DataFrame:
    """Ids of all live pages below one page: an interval of its tree.

    `known` is what `forest` or a table of `write_forest` holds; such a table is
    read only where the interval lies.
    """
    known = forest(pages) if known is None else known
    own = known.filter(F.col("id") == page_id).first()
    if own is None:  # not a live page: the trees of its children are whole trees
        tops = active(pages).filter(F.col("parent_id") == page_id).select(F.col("id").alias("root"))
        return known.filter("not cyclic").join(tops, "root", "left_semi").select("id")
    if own.cyclic:
        return _below_in_circles(pages, page_id)
    return known.filter((F.col("root") == own.root) & (F.col("place") > own.place) & (F.col("place") < own.place + own.size) & ~F.col("cyclic")).select("id")


def _below_in_circles(pages: DataFrame, page_id: int) -> DataFrame:
    """Pages below one that is part of a circle or below one: level by level, each once."""
    children = active(pages).select("id", "parent_id").filter(F.col("parent_id").isNotNull())
    frontier = cut_lineage(children.filter((F.col("parent_id") == page_id) & (F.col("id") != page_id)).select("id"))
    found = frontier
    while not frontier.isEmpty():
        below = children.join(frontier.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").filter(F.col("id") != page_id).select("id")
        frontier = cut_lineage(below.join(found, "id", "left_anti"))
        found = cut_lineage(found.unionByName(frontier))
    return found


def parent_candidates(pages: DataFrame, page_id: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Live pages that may become the parent of a page: not itself and nothing below it."""
    live = active(pages).select("id", "title", "alias")
    if page_id is None:
        return live.orderBy(F.lower("title"), "id")
    below = descendants(pages, page_id, known)
    return live.filter(F.col("id") != page_id).join(below, "id", "left_anti").orderBy(F.lower("title"), "id")


def _endless(pointers: DataFrame) -> tuple[DataFrame, int]:
    """(id, next) of pages whose way up never ends, `next` some way up, and their number.

    Pointers alone are doubled; a page whose way ends leaves in the round that finds it.
    """
    left = written(pointers.filter("next is not null"))
    size, before = left.count(), -1
    # A round that no page leaves is followed by none that any leaves: what is left runs in circles.
    while size and size != before:
        after = written(left.join(left.select(F.col("id").alias("next"), F.col("next").alias("_next")), "next").select("id", F.col("_next").alias("next")))
        release(left)
        left, before, size = after, size, after.count()
    return left, size


def in_circles(pages: DataFrame) -> DataFrame:
    """Ids of live pages that are their own ancestors."""
    _, inner = _linked(active(pages).filter("id is not null").select("id", "parent_id"))
    left, size = _endless(inner.select("id", F.col("parent_id").alias("next")))
    reach = 1
    # From far enough up, everything lands on a circle, and every page of a circle is landed on.
    while reach < size:
        after = written(left.join(left.select(F.col("id").alias("next"), F.col("next").alias("_next")), "next").select("id", F.col("_next").alias("next")))
        left, reach = after, reach * 2
    return left.select(F.col("next").alias("id")).distinct()


def parent_errors(pages: DataFrame, proposals: DataFrame) -> DataFrame:
    """Check proposed parents, (id, new_parent_id), against the stored forest: adds `error`, null when accepted.

    A page lies above another one if its interval holds the other one's place.
    """
    known = forest(pages)
    named = lambda key, prefix: known.select(F.col("id").alias(key), *[F.col(name).alias(prefix + name) for name in ("root", "place", "size", "cyclic")])
    joined = proposals.join(named("new_parent_id", "_p_"), "new_parent_id", "left").join(named("id", "_"), "id", "left")
    inside = ~F.col("_p_cyclic") & ~F.col("_cyclic") & (F.col("_root") == F.col("_p_root")) & (F.col("_p_place") >= F.col("_place")) & (F.col("_p_place") < F.col("_place") + F.col("_size"))
    caught = known.filter("cyclic").select("id")
    if not caught.isEmpty():  # circles that are stored already have no places: their chains are short or the forest is broken
        above = chains(active(pages).select("id", "parent_id").join(caught, "id", "left_semi")).select(F.col("id").alias("new_parent_id"), F.transform("chain", lambda item: item["id"]).alias("_above"))
        joined = joined.join(above, "new_parent_id", "left")
        inside = inside | F.array_contains("_above", F.col("id"))
    error = (
        F.when(F.col("new_parent_id").isNull(), F.lit(None).cast("string"))
        .when(F.col("new_parent_id") == F.col("id"), F.lit("a page cannot be its own parent"))
        .when(F.col("_p_root").isNull(), F.lit("parent page not found"))
        .when(F.coalesce(inside, F.lit(False)), F.lit("parent relationship would create a cycle"))
        .when(F.col("_p_cyclic"), F.lit("existing parent relationship contains a cycle"))
    )
    return joined.select("id", "new_parent_id", error.alias("error"))
