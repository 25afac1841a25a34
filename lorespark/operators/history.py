"""Revisions, differences, and detection of human edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import previous_within

TRACKED = ["title", "alias", "body", "tags", "status", "parent_id", "properties"]
METADATA = ["title", "alias", "tags", "status", "parent_id", "properties"]
MANAGED = ["title", "body", "tags", "properties"]


def comparable(column: str | Column, is_map: bool = False) -> Column:
    """A column in a form that null-safe equality accepts; maps compare as ordered entries."""
    value = F.col(column) if isinstance(column, str) else column
    return F.array_sort(F.map_entries(value)) if is_map else value


def differs(left: str, right: str, columns: list[str]) -> Column:
    """True when any column differs between two struct columns; nulls compare as equal."""
    changed = F.lit(False)
    for name in columns:
        is_map = name == "properties"
        changed = changed | ~comparable(F.col(left)[name], is_map).eqNullSafe(comparable(F.col(right)[name], is_map))
    return changed


def revisions_of_changes(current: DataFrame, updates: DataFrame, source: str, now: str) -> DataFrame:
    """Snapshots of the prior state of every page that an update batch really changes.

    `updates` has at most one row per page; a null field keeps the old value,
    except `parent_id`, which is taken when `set_parent` is true.
    """
    old = F.struct(*[F.col(f"o.{name}").alias(name) for name in TRACKED])
    given = set(updates.columns)
    new = F.struct(
        *[
            F.when(F.col("n.set_parent"), F.col("n.parent_id")).otherwise(F.col("o.parent_id")).alias("parent_id")
            if name == "parent_id" and "set_parent" in given
            else F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}")).alias(name)
            if name in given and name != "parent_id"
            else F.col(f"o.{name}").alias(name)
            for name in TRACKED
        ]
    )
    joined = current.alias("o").join(updates.alias("n"), F.col("o.id") == F.col("n.id")).select(F.col("o.id").alias("page_id"), old.alias("old"), new.alias("new"))
    changed = joined.filter(differs("old", "new", TRACKED))
    return changed.select("page_id", "old.*", F.lit(source).alias("source"), F.lit(now).cast("timestamp_ntz").alias("created_at"), "new")


def changes_in_stream(events: DataFrame, key: str, order: list[str], columns: list[str], bucket: Column) -> DataFrame:
    """Rows of a change history that differ from the row before them, with the prior values.

    The first row of a key creates it and is no change. A key may hold any share
    of the history; see `previous_within`.
    """
    looked = previous_within(events.withColumn("_known", F.lit(True)), key, bucket, order, [*columns, "_known"])
    changed = F.lit(False)
    for name in columns:
        changed = changed | ~F.col(name).eqNullSafe(F.col(f"prev_{name}"))
    return looked.filter(F.col("prev__known") & changed).drop("_known", "prev__known")


def compare_revisions(revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """Each revision against the current page: metadata flag and both bodies."""
    old = F.struct(*[F.col(f"r.{name}").alias(name) for name in [*METADATA, "body"]])
    new = F.struct(*[F.col(f"p.{name}").alias(name) for name in [*METADATA, "body"]])
    joined = revisions.alias("r").join(pages.alias("p"), F.col("r.page_id") == F.col("p.id"))
    paired = joined.select(F.col("r.id").alias("revision_id"), "r.page_id", old.alias("from"), new.alias("to"))
    return paired.withColumn("metadata_changed", differs("from", "to", METADATA))


def revision_of(revisions: DataFrame, pages: DataFrame, page_id: int, revision_id: int) -> DataFrame:
    """One revision of a live page; no row when the page lies in the trash or the revision is another page's."""
    wanted = revisions.filter((F.col("id") == revision_id) & (F.col("page_id") == page_id))
    live = pages.filter(F.col("deleted_at").isNull() & (F.col("id") == page_id)).select(F.col("id").alias("page_id"))
    return wanted.join(live, "page_id", "left_semi")


def restore_updates(revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """Updates (see `lifecycle.update_pages`) that bring live pages back to a revision, at most one revision per page.

    A parent that is not live any more is dropped. An alias that another live page
    owns by now is marked in `suffix_alias`: it gets the next free number.
    """
    # The bodies of the revisions move once, by page; aliases and parents are looked up without them.
    looked = _looked_up(revisions.select("page_id", "alias", "parent_id"), pages).select("page_id", F.col("parent_id").alias("_parent_id"), "alias_taken")
    return revisions.join(looked, "page_id").select(
        F.col("page_id").alias("id"), "title", "alias", "body", "tags", "status", F.col("_parent_id").alias("parent_id"), F.lit(True).alias("set_parent"), "properties",
        F.col("alias_taken").alias("suffix_alias"),
    )


def _looked_up(revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, alias, parent_id, alias_taken) of revisions of live pages; a parent that is not live is null."""
    live = pages.filter(F.col("deleted_at").isNull())
    owners = live.select(F.col("alias"), F.col("id").alias("_owner"))
    parents = live.select(F.col("id").alias("parent_id"), F.lit(True).alias("_parent_exists"))
    known = revisions.join(live.select(F.col("id").alias("page_id")), "page_id", "left_semi")
    joined = known.join(owners, "alias", "left").join(parents, "parent_id", "left")
    return joined.select(
        "page_id", "alias", F.when(F.col("_parent_exists"), F.col("parent_id")).alias("parent_id"),
        (F.col("_owner").isNotNull() & (F.col("_owner") != F.col("page_id"))).alias("alias_taken"),
    )


def restore_revisions(revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, alias, parent_id, alias_taken) that restoring each revision would lead to."""
    return _looked_up(revisions.select("page_id", "alias", "parent_id"), pages)


def human_edited(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with `needs_review`: set for good once the page differs from what was last managed."""
    page = F.struct(*[F.col(f"p.{name}").alias(name) for name in MANAGED])
    managed = F.struct(*[F.col(f"d.managed_{name}").alias(name) for name in MANAGED])
    joined = documents.alias("d").join(pages.alias("p"), F.col("d.page_id") == F.col("p.id"))
    compared = joined.select(F.col("d.id").alias("document_id"), "d.page_id", page.alias("page"), managed.alias("managed"), F.col("d.needs_review").alias("_flag"))
    return compared.select("document_id", "page_id", differs("page", "managed", MANAGED).alias("edited"), (F.col("_flag") | differs("page", "managed", MANAGED)).alias("needs_review"))


def _lines(text: str) -> list[str]:
    """Lines with their breaks: a last line without one differs from the same line with one."""
    parts = text.split("\n")
    return [part + "\n" for part in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _split_point(old: list[int], new: list[int]) -> tuple[int, int, int]:
    """(edits, x, y): a point on a shortest path through the edit grid, found from both ends at once (Myers 1986).

    Only the furthest places of the diagonals are kept, so memory grows with the lines.
    """
    n, m = len(old), len(new)
    delta, half = n - m, (n + m + 1) // 2
    ahead, behind = {1: 0}, {1: 0}
    for steps in range(half + 1):
        for reach, forward in ((ahead, True), (behind, False)):
            for diagonal in range(-steps, steps + 1, 2):
                down = diagonal == -steps or (diagonal != steps and reach.get(diagonal - 1, -1) < reach.get(diagonal + 1, -1))
                x = reach[diagonal + 1] if down else reach[diagonal - 1] + 1
                y = x - diagonal
                while x < n and y < m and (old[x] == new[y] if forward else old[n - 1 - x] == new[m - 1 - y]):
                    x, y = x + 1, y + 1
                reach[diagonal] = x
                other = behind if forward else ahead
                opposite = delta - diagonal
                if (delta % 2 == 1) == forward and abs(opposite) <= (steps - 1 if forward else steps) and opposite in other and x + other[opposite] >= n:
                    return (2 * steps - 1, x, y) if forward else (2 * steps, n - x, m - y)
    raise AssertionError("the two searches always meet")


def _common(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in order."""
    pairs: list[tuple[int, int]] = []
    work = [(0, len(old), 0, len(new))]
    while work:
        low, high, left, right = work.pop()
        while low < high and left < right and old[low] == new[left]:
            pairs.append((low, left))
            low, left = low + 1, left + 1
        tail = []
        while low < high and left < right and old[high - 1] == new[right - 1]:
            high, right = high - 1, right - 1
            tail.append((high, right))
        pairs += tail
        if low < high and left < right:
            edits, x, y = _split_point(old[low:high], new[left:right])
            if edits > 1:
                work += [(low + x, high, left + y, right), (low, low + x, left, left + y)]
            # One edit with equal ends set aside leaves nothing in common.
    return sorted(pairs)


def edit_script(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """Shortest line edit as (kind, line); kind is one of same, removed, added. Removals come before additions.

    Lines that the other side does not have cannot be kept, so only the others are searched.
    """
    numbers = {line: number for number, line in enumerate(dict.fromkeys(before))}
    present = set(after)
    old = [place for place, line in enumerate(before) if line in present]
    new = [place for place, line in enumerate(after) if line in numbers]
    kept = [(old[x], new[y]) for x, y in _common([numbers[before[place]] for place in old], [numbers[after[place]] for place in new])]
    script, x, y = [], 0, 0
    for next_x, next_y in [*kept, (len(before), len(after))]:
        script += [("removed", line) for line in before[x:next_x]] + [("added", line) for line in after[y:next_y]]
        if next_x < len(before):
            script.append(("same", before[next_x]))
        x, y = next_x + 1, next_y + 1
    return script


def side_by_side(before: str, after: str) -> list[dict]:
    """Rows of a two-column view; a removed block faces the added block that follows it."""
    rows, removed, added = [], [], []

    def flush():
        for index in range(max(len(removed), len(added))):
            left = removed[index].removesuffix("\n") if index < len(removed) else None
            right = added[index].removesuffix("\n") if index < len(added) else None
            rows.append({"left": left, "right": right, "left_kind": "blank" if left is None else "removed", "right_kind": "blank" if right is None else "added"})
        removed.clear()
        added.clear()

    for kind, line in edit_script(_lines(before), _lines(after)):
        if kind == "same":
            flush()
            shown = line.removesuffix("\n")
            rows.append({"left": shown, "right": shown, "left_kind": "same", "right_kind": "same"})
        else:
            (removed if kind == "removed" else added).append(line)
    flush()
    return rows


DIFF_ROWS = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("left", "right", "left_kind", "right_kind")]))


@F.pandas_udf(DIFF_ROWS)
def diff_rows(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([side_by_side(left or "", right or "") for left, right in zip(before, after)], dtype=object)


def body_diff(pairs: DataFrame, before: str, after: str, keep: list[str]) -> DataFrame:
    """One row per line of the two-column view, numbered from 0. Equal bodies skip the comparison."""
    return pairs.select(*keep, F.posexplode(diff_rows(F.col(before), F.col(after))).alias("line", "row")).select(*keep, "line", "row.*")
