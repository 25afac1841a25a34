"""Batches of page changes: create, update, delete, restore, purge.

Tables are immutable snapshots. Each function returns the new rows, and what was
refused with its reason; `sources.tables.publish` makes a snapshot current.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_valid_alias, normalize_alias, normalize_tags, slugify, strip, tags_error
from ..model import MAX_BODY_BYTES, MAX_TITLE_CHARS, PAGE_STATUSES
from ..session import cut_lineage, written
from .filters import active, deleted, normalize_properties, properties_error
from .history import TRACKED, revisions_of_changes
from .scale import count_before, number_within
from .taxonomy import resolve_tag_rows
from .tree import in_circles

PAGE_COLUMNS = ["id", "title", "alias", "body", "tags", "status", "parent_id", "properties", "created_at", "updated_at", "deleted_at", "deleted_alias"]


def candidate(base, number):
    """base, base-2, base-3, ...; numbered forms use the first 190 characters of the base."""
    return F.when(number == 1, base).otherwise(F.concat(F.substring(base, 1, 190), F.lit("-"), number.cast("string")))


def assign_aliases(proposals: DataFrame, taken: DataFrame) -> DataFrame:
    """Free alias for every proposal (id, base), as if they came one after another by id.

    The n-th proposal of a base takes its n-th open number. A number is closed
    by a stored alias, or because another base is spelled like it and its first
    proposal came earlier; see `_contested`.
    """
    ranked = cut_lineage(number_within(proposals.select("id", "base"), "base", "id", name="_nth"))
    stored = cut_lineage(_stored_numbers(ranked.select("base").distinct(), taken.select("alias").distinct()))
    closed = cut_lineage(stored.unionByName(_contested(ranked, stored)).distinct())
    while True:
        placed = ranked.join(_open_numbers(ranked, closed), ["base", "_nth"]).select("id", "base", "number", candidate(F.col("base"), F.col("number")).alias("alias"))
        placed = cut_lineage(placed)
        # Only bases that differ after their first 190 characters can still meet.
        winners = placed.groupBy("alias").agg(F.min("id").alias("_winner"), F.count("*").alias("_claims")).filter(F.col("_claims") > 1)
        losers = cut_lineage(placed.join(winners, "alias").filter(F.col("id") != F.col("_winner")).select("base", "number").distinct())
        if not losers.limit(1).count():
            return placed.select("id", "alias")
        closed = cut_lineage(closed.unionByName(losers).distinct())


def _stored_numbers(bases: DataFrame, aliases: DataFrame) -> DataFrame:
    """(base, number) of the candidates of proposed bases that are stored already."""
    direct = aliases.select(F.col("alias").alias("base"), F.lit(1).cast("bigint").alias("number")).join(bases, "base", "left_semi")
    stems = bases.select("base", F.substring("base", 1, 190).alias("stem"))
    return direct.unionByName(_split_numbers(aliases).join(stems, "stem").select("base", "number")).distinct()


def _split_numbers(aliases: DataFrame) -> DataFrame:
    """(alias, stem, number) of aliases that end in a number of two or more."""
    numbered = aliases.filter(F.col("alias").rlike("-[1-9][0-9]*$"))
    return numbered.select("alias", F.regexp_extract("alias", "^(.*)-[0-9]+$", 1).alias("stem"), F.regexp_extract("alias", "([0-9]+)$", 1).try_cast("bigint").alias("number")).filter(F.col("number") >= 2)


def _contested(ranked: DataFrame, stored: DataFrame) -> DataFrame:
    """(base, number) closed by proposals of other bases.

    The alias "a-3" is the third candidate of base "a" and the first one of base
    "a-3". The first proposal of "a-3" wins when fewer proposals of "a" came
    before it than "a" needs to reach its third number. That need depends on the
    smaller contested numbers of "a", and on whether "a" itself was lost to its
    own stem; so all decisions are repeated until none changes. Only bases take
    part here, not proposals.
    """
    firsts = ranked.groupBy("base").agg(F.min("id").alias("first"))
    stems = firsts.select("base", F.substring("base", 1, 190).alias("stem"))
    children = _split_numbers(firsts.select(F.col("base").alias("alias"))).join(firsts.select(F.col("base").alias("alias"), "first"), "alias")
    pairs = children.join(stems, "stem").select("base", "number", F.col("alias").alias("child"), "first").join(stored, ["base", "number"], "left_anti")
    entries = cut_lineage(pairs)
    if not entries.limit(1).count():
        return stored.limit(0)
    came = count_before(ranked.select("base", F.col("id").alias("at")), entries.withColumn("at", F.col("first")), "base", "at", "came").drop("at")
    skipped = count_before(stored.select("base", F.col("number").alias("at")), came.withColumn("at", F.col("number")), "base", "at", "skipped").drop("at")
    state = cut_lineage(skipped.withColumn("won", F.lit(False)))
    while True:
        # A child that lost its own name cannot give its first number away.
        lost = state.filter(~F.col("won")).select(F.col("child").alias("base"), F.lit(1).alias("_lost"))
        earlier = count_before(state.filter("won").select("base", F.col("number").alias("at")), state.withColumn("at", F.col("number")), "base", "at", "_earlier").drop("at")
        need = F.col("number") - F.col("skipped") - F.coalesce("_lost", F.lit(0)) - F.col("_earlier")
        decided = cut_lineage(earlier.join(lost, "base", "left").withColumn("_now", F.col("came") < need))
        changed = decided.filter(F.col("won") != F.col("_now")).limit(1).count()
        state = decided.withColumn("won", F.col("_now")).drop("_now", "_earlier", "_lost")
        if not changed:
            break
    by_children = state.filter("won").select("base", "number")
    own_names = state.filter(~F.col("won")).select(F.col("child").alias("base"), F.lit(1).cast("bigint").alias("number"))
    return by_children.unionByName(own_names)


def _open_numbers(ranked: DataFrame, closed: DataFrame) -> DataFrame:
    """(base, _nth, number): the n-th number of a base that is not closed, for every rank in use.

    A base with n proposals and c closed numbers needs no number beyond n + c.
    """
    counts = ranked.groupBy("base").agg(F.max("_nth").alias("_proposals"))
    beyond = number_within(closed, "base", "number", name="_extra").join(counts, "base").select("base", (F.col("_proposals") + F.col("_extra")).alias("number"))
    numbers = ranked.select("base", F.col("_nth").alias("number")).unionByName(beyond)
    return number_within(numbers.join(closed, ["base", "number"], "left_anti"), "base", "number", name="_nth").select("base", "_nth", "number")


def input_error():
    """Reason why a page input is refused, or null."""
    return F.coalesce(
        F.when(~F.length(strip(F.col("title"))).between(1, MAX_TITLE_CHARS) | F.col("title").isNull(), F.lit("title must have 1 to 200 characters")),
        F.when(F.octet_length("body") > MAX_BODY_BYTES, F.lit("body is too large")),
        tags_error(F.col("tags")),
        properties_error(F.col("properties")),
        F.when(~F.col("status").isin(*PAGE_STATUSES), F.lit("status is unknown")),
        F.when(F.col("alias").isNotNull() & ~is_valid_alias(F.col("alias")), F.lit("alias must contain lowercase ASCII letters, numbers, and single hyphens")),
    )


def create_pages(pages: DataFrame, inputs: DataFrame, now: str, imported: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new pages, refused inputs with error). Inputs carry a `no` that orders them.

    An explicit alias that is taken is refused, or suffixed when `imported`.
    """
    defaults = {"body": F.lit(""), "status": F.lit("published"), "tags": F.array().cast("array<string>"), "properties": F.create_map().cast("map<string,string>")}
    shaped = inputs
    for name, value in defaults.items():
        shaped = shaped.withColumn(name, F.coalesce(F.col(name), value) if name in inputs.columns else value)
    for name, kind in {"alias": "string", "parent_id": "bigint"}.items():
        if name not in inputs.columns:
            shaped = shaped.withColumn(name, F.lit(None).cast(kind))
    shaped = shaped.withColumn("alias", normalize_alias(F.col("alias"))).withColumn("tags", normalize_tags(F.col("tags"))).withColumn("title", strip(F.col("title")))
    parents = active(pages).select(F.col("id").alias("parent_id"), F.lit(True).alias("_parent"))
    owners = pages.select("alias", F.lit(True).alias("_owned"))
    checked = shaped.withColumn("error", input_error()).join(parents, "parent_id", "left").join(owners, "alias", "left")
    error = F.coalesce(F.col("error"), F.when(F.col("parent_id").isNotNull() & F.col("_parent").isNull(), F.lit("parent page not found")))
    if not imported:
        error = F.coalesce(error, F.when(F.col("alias").isNotNull() & F.col("_owned"), F.lit("alias already exists")))
    checked = cut_lineage(checked.withColumn("error", error).drop("_parent", "_owned"))
    refused = checked.filter(F.col("error").isNotNull())
    good = checked.filter(F.col("error").isNull()).drop("error").withColumn("base", F.coalesce("alias", slugify(F.col("title"))))
    if not imported:
        # An explicit alias keeps its exact form: of several equal ones the first wins.
        first = good.filter(F.col("alias").isNotNull()).groupBy("alias").agg(F.min("no").alias("_first"))
        marked = good.join(first, "alias", "left")
        repeated = F.col("alias").isNotNull() & (F.col("no") != F.col("_first"))
        refused = refused.unionByName(marked.filter(repeated).select(*[c for c in good.columns if c != "base"]).withColumn("error", F.lit("alias already exists")))
        good = marked.filter(~F.coalesce(repeated, F.lit(False))).drop("_first")
    free = assign_aliases(good.select(F.col("no").alias("id"), "base"), pages.select("alias")).select(F.col("id").alias("no"), F.col("alias").alias("_alias"))
    largest = pages.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    moment = F.lit(now).cast("timestamp_ntz")
    # Ids follow the order of the inputs without a global window: numbering runs per span of `no`.
    numbered = number_within(good.withColumn("_all", F.lit(1)), "_all", "no", name="_position")
    created = numbered.join(free, "no").select(
        (largest + F.col("_position")).cast("bigint").alias("id"), "title", F.col("_alias").alias("alias"), "body", "tags", "status", "parent_id",
        normalize_properties(F.col("properties")).alias("properties"), moment.alias("created_at"), moment.alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.lit(None).cast("string").alias("deleted_alias"),
    )
    return created, refused.select("no", "error")


def checked_updates(pages: DataFrame, updates: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Updates in normal form with `error`, as if they came one after another by page id.

    Null fields keep the old value; `parent_id` counts where `set_parent` is true.
    An alias is refused when another page owns it before the batch, unless that
    page gives it up for good (its own update, not refused, has another one) with
    a smaller id; of several updates that want one alias the least id wins. A
    parent must be live, and the parents of the whole batch may make no circle.
    With `aliases` (alias, canonical_tag) tags are resolved.
    """
    rows, verdicts = _judged(pages, updates, aliases)
    error = F.when(F.col("id").isNull(), F.lit("page not found")).otherwise(F.col("error"))
    return rows.join(verdicts.select("id", "error"), "id", "left").withColumn("error", error)


def _judged(pages: DataFrame, updates: DataFrame, aliases: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(updates in normal form, verdicts), see `checked_updates`.

    The updates are a table that is written once. Verdicts have no texts: id,
    alias, set_parent, suffix_alias and `error`, a row for each update.
    """
    kinds = {"title": "string", "alias": "string", "body": "string", "tags": "array<string>", "status": "string", "parent_id": "bigint", "properties": "map<string,string>", "set_parent": "boolean", "suffix_alias": "boolean"}
    shaped = updates.select("id", *[F.col(name).cast(kind).alias(name) if name in updates.columns else F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    shaped = shaped.withColumn("alias", normalize_alias(F.col("alias"))).withColumn("tags", F.when(F.col("tags").isNotNull(), normalize_tags(F.col("tags")))).withColumn("title", strip(F.col("title")))
    if aliases is not None:
        tags = shaped.filter(F.col("tags").isNotNull()).select(F.col("id").alias("page_id"), F.explode("tags").alias("tag"))
        resolved = resolve_tag_rows(tags, aliases).groupBy(F.col("page_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
        shaped = shaped.join(resolved, "id", "left").withColumn("tags", F.when(F.size("tags") > 0, F.col("_tags")).otherwise(F.col("tags"))).drop("_tags")
    live = active(pages).select("id", F.col("alias").alias("_old_alias"), F.lit(True).alias("_live"))
    parents = active(pages).select(F.col("id").alias("parent_id"), F.lit(True).alias("_parent"))
    own = F.coalesce(
        F.when(F.col("title").isNotNull() & ~F.length("title").between(1, MAX_TITLE_CHARS), F.lit("title must have 1 to 200 characters")),
        F.when(F.octet_length("body") > MAX_BODY_BYTES, F.lit("body is too large")),
        F.when(F.col("tags").isNotNull(), tags_error(F.col("tags"))),
        F.when(F.col("properties").isNotNull(), properties_error(F.col("properties"))),
        F.when(F.col("status").isNotNull() & ~F.col("status").isin(*PAGE_STATUSES), F.lit("status is unknown")),
        F.when(F.col("alias").isNotNull() & ~is_valid_alias(F.col("alias")), F.lit("alias must contain lowercase ASCII letters, numbers, and single hyphens")),
    )
    # Bodies take no part in what follows: every join below moves ids, aliases and errors.
    shaped = written(shaped.withColumn("_own_error", own))
    error = F.coalesce(
        F.when(F.col("_live").isNull(), F.lit("page not found")),
        F.col("_own_error"),
        F.when(F.coalesce("set_parent", F.lit(False)) & F.col("parent_id").isNotNull() & F.col("_parent").isNull(), F.lit("parent page not found")),
    )
    narrow = shaped.select("id", "alias", "parent_id", "set_parent", "suffix_alias", "_own_error")
    checked = cut_lineage(narrow.join(live, "id", "left").join(parents, "parent_id", "left").withColumn("error", error).drop("_live", "_parent", "_own_error"))

    # Circles: the forest as the whole batch would leave it. Only a page that gets a parent can close one.
    moved = checked.filter(F.col("error").isNull() & F.coalesce("set_parent", F.lit(False))).select("id", F.col("parent_id").alias("_new_parent"), F.lit(True).alias("_moved"))
    if moved.filter("_new_parent is not null").isEmpty():
        circular = moved.select("id", F.lit("").alias("_circle")).filter(F.lit(False))
    else:
        forest = active(pages).join(moved, "id", "left").withColumn("parent_id", F.when(F.col("_moved"), F.col("_new_parent")).otherwise(F.col("parent_id"))).drop("_new_parent", "_moved")
        circular = in_circles(forest).join(moved.select("id"), "id", "left_semi").select("id", F.lit("parent relationship would create a cycle").alias("_circle"))

    # Aliases: who owns one before, and who asks for it now.
    wants = checked.filter(F.col("error").isNull() & F.col("alias").isNotNull() & ~F.coalesce("suffix_alias", F.lit(False)) & ~F.col("alias").eqNullSafe(F.col("_old_alias")))
    first = wants.groupBy("alias").agg(F.min("id").alias("_first"))
    owners = pages.select("alias", F.col("id").alias("_owner"))
    leaving = wants.select(F.col("id").alias("_owner"), F.lit(True).alias("_leaves"))
    contested = wants.select("id", "alias").join(first, "alias").join(owners, "alias", "left").join(leaving, "_owner", "left")
    taken = (F.col("id") != F.col("_first")) | (F.col("_owner").isNotNull() & ~(F.coalesce("_leaves", F.lit(False)) & (F.col("_owner") < F.col("id"))))
    # An owner whose own update is refused keeps its alias after all: owners point at owners, and
    # pointer doubling tells in log2 rounds who waits, over any number of hops, for a refused one.
    pointed = lambda owner: F.when(~F.col("_taken"), owner).alias("_owner")
    refused = cut_lineage(contested.select("id", F.col("_owner").alias("_next"), taken.alias("_taken")).select("id", pointed(F.col("_next")), "_taken"))
    while not refused.filter("_owner is not null").isEmpty():
        ahead = refused.select(F.col("id").alias("_owner"), F.col("_owner").alias("_next"), F.col("_taken").alias("_stays"))
        joined = refused.join(ahead, "_owner", "left").select("id", "_next", (F.col("_taken") | F.coalesce("_stays", F.lit(False))).alias("_taken"))
        refused = cut_lineage(joined.select("id", pointed(F.col("_next")), "_taken"))
    taken_rows = refused.filter("_taken").select("id", F.lit("alias already exists").alias("_alias_error"))
    joined = checked.join(circular, "id", "left").join(taken_rows, "id", "left")
    verdicts = joined.select("id", "alias", "set_parent", "suffix_alias", F.coalesce("error", "_circle", "_alias_error").alias("error"))
    return shaped.drop("_own_error"), cut_lineage(verdicts)


def update_pages(pages: DataFrame, updates: DataFrame, source: str, now: str, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages after the batch, revisions written, refused updates with error).

    Unchanged pages keep their time and get no revision. Updates with
    `suffix_alias` get the next number that is free before and after the batch if
    their alias is taken.
    """
    rows, verdicts = _judged(pages, updates, aliases)
    good = verdicts.filter(F.col("error").isNull()).drop("error")
    suffixed = good.filter(F.coalesce("suffix_alias", F.lit(False)))
    others = pages.join(suffixed.select("id"), "id", "left_anti").select("alias").unionByName(good.filter(~F.coalesce("suffix_alias", F.lit(False)) & F.col("alias").isNotNull()).select("alias"))
    free = assign_aliases(suffixed.select("id", F.col("alias").alias("base")), others).select("id", F.col("alias").alias("_free"))
    accepted = cut_lineage(good.join(free, "id", "left").select("id", F.coalesce("_free", "alias").alias("alias"), F.coalesce("set_parent", F.lit(False)).alias("set_parent")))
    plain = rows.drop("alias", "set_parent", "suffix_alias").withColumn("properties", F.when(F.col("properties").isNotNull(), normalize_properties(F.col("properties"))))
    # Which pages change is told by digests of the bodies; the bodies themselves meet once, in the pages after the batch.
    digested = lambda frame: frame.withColumn("body", F.unhex(F.sha2("body", 256)))
    moved = revisions_of_changes(digested(active(pages)), digested(plain).join(accepted, "id"), source, now).select(F.col("page_id").alias("id"))
    # A table has no partitioning that the rows with bodies would have to follow.
    changed = written(accepted.join(moved, "id", "left_semi"))
    revisions = active(pages).join(changed.select("id"), "id", "left_semi").select(F.col("id").alias("page_id"), *TRACKED, F.lit(source).alias("source"), F.lit(now).cast("timestamp_ntz").alias("created_at"))
    new = plain.join(changed, "id").alias("n")
    joined = pages.alias("o").join(new, F.col("o.id") == F.col("n.id"), "left")
    values = {name: F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}")) for name in TRACKED}
    values["parent_id"] = F.when(F.col("n.set_parent"), F.col("n.parent_id")).otherwise(F.col("o.parent_id"))
    values["updated_at"] = F.when(F.col("n.id").isNotNull(), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("o.updated_at"))
    applied = joined.select(*[values.get(name, F.col(f"o.{name}")).alias(name) for name in PAGE_COLUMNS])
    return applied, revisions, verdicts.filter(F.col("error").isNotNull()).select("id", "error")


def delete_pages(pages: DataFrame, chosen: DataFrame, now: str) -> DataFrame:
    """Move live pages to the trash; their alias becomes free and is remembered."""
    marked = pages.join(chosen.select("id", F.lit(True).alias("_chosen")).distinct(), "id", "left")
    gone = F.coalesce(F.col("_chosen") & F.col("deleted_at").isNull(), F.lit(False))
    moment = F.lit(now).cast("timestamp_ntz")
    return marked.select(
        *[
            F.when(gone, value).otherwise(F.col(name)).alias(name) if value is not None else F.col(name)
            for name, value in ((name, {"alias": F.concat(F.lit("deleted-page-"), F.col("id").cast("string")), "deleted_alias": F.col("alias"), "deleted_at": moment, "updated_at": moment}.get(name)) for name in PAGE_COLUMNS)
        ]
    )


def restore_pages(pages: DataFrame, chosen: DataFrame, now: str) -> DataFrame:
    """Bring pages back from the trash under their old alias, suffixed when it is taken."""
    marked = deleted(pages).join(chosen.select("id").distinct(), "id", "left_semi")
    rest = pages.join(marked.select("id"), "id", "left_anti")
    free = assign_aliases(marked.select("id", F.col("deleted_alias").alias("base")), rest.select("alias"))
    moment = F.lit(now).cast("timestamp_ntz")
    back = marked.drop("alias", "deleted_alias", "deleted_at", "updated_at").join(free, "id").select(
        *[{"deleted_at": F.lit(None).cast("timestamp_ntz"), "deleted_alias": F.lit(None).cast("string"), "updated_at": moment}.get(name, F.col(name)).alias(name) for name in PAGE_COLUMNS]
    )
    return rest.select(PAGE_COLUMNS).unionByName(back)


def purge_pages(pages: DataFrame, chosen: DataFrame, dependents: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Remove trashed pages for good, with every dependent row: {table: (rows, page column)}."""
    gone = deleted(pages).join(chosen.select("id").distinct(), "id", "left_semi").select("id")
    result = {"pages": pages.join(gone, "id", "left_anti")}
    for name, (rows, column) in dependents.items():
        result[name] = rows.join(gone.select(F.col("id").alias(column)), column, "left_anti")
    return result
