"""Tag definitions, aliases, usage, and topics proposed by a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.text import normalize_tags, slugify, strip, tag_kind
from .filters import active, tag_rows
from .scale import top_per_group

TOPIC_REPLY = "struct<topics:array<string>>"


def tag_counts(pages: DataFrame) -> DataFrame:
    """(tag, count) over live published pages, in tag order."""
    shown = active(pages).filter(F.col("status") == "published")
    return tag_rows(shown).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("count")).orderBy("tag")


def implicit_definitions(page_tags: DataFrame) -> DataFrame:
    """Definitions of tags that are in use but were never defined."""
    return page_tags.select("tag").distinct().select("tag", tag_kind(F.col("tag")).alias("kind"), F.col("tag").alias("display_name"))


def definition_usage(definitions: DataFrame, page_tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Definitions with sorted aliases and the number of pages, of any state, that carry the tag."""
    used = page_tags.groupBy("tag").agg(F.count("*").alias("usage_count"))
    named = aliases.groupBy(F.col("canonical_tag").alias("tag")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    joined = definitions.join(used, "tag", "left").join(named, "tag", "left")
    return joined.withColumn("usage_count", F.coalesce("usage_count", F.lit(0))).withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>"))
    ).orderBy(F.desc("usage_count"), "tag")


def resolve_tag_rows(page_tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace aliases by canonical tags, one hop only, keeping one row per page and tag."""
    names = aliases.select(F.col("alias").alias("tag"), "canonical_tag")
    joined = page_tags.join(names, "tag", "left")
    return joined.select("page_id", F.coalesce("canonical_tag", "tag").alias("tag")).distinct()


def resolve_tags(tags: list[str], aliases: DataFrame) -> list[str]:
    """The same for the few tags of one request."""
    from ..functions.text import check_tags

    wanted = check_tags(tags)
    if not wanted:
        return []
    found = {row["alias"]: row["canonical_tag"] for row in aliases.filter(F.col("alias").isin(wanted)).select("alias", "canonical_tag").take(len(wanted))}
    return check_tags([found.get(tag, tag) for tag in wanted])


def alias_conflicts(proposed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Proposed (alias, canonical_tag) pairs whose alias already belongs to another tag."""
    owned = aliases.select("alias", F.col("canonical_tag").alias("owner"))
    return proposed.join(owned, "alias").filter(F.col("owner") != F.col("canonical_tag"))


def define_tags(definitions: DataFrame, aliases: DataFrame, page_tags: DataFrame, proposed: DataFrame, now: str) -> dict[str, DataFrame]:
    """Apply definitions (tag, kind, display_name, description, aliases, created_by).

    Returns the new definitions, aliases and page tags, the refused rows, and the
    pages to index again. Aliases of a proposed alias follow it to its new tag.
    """
    clean = proposed.withColumn("aliases", F.filter(normalize_tags(F.col("aliases")), lambda alias: alias != F.col("tag")))
    pairs = clean.select(F.explode("aliases").alias("alias"), F.col("tag").alias("canonical_tag"))
    refused = alias_conflicts(pairs, aliases).select(F.col("canonical_tag").alias("tag")).distinct()
    accepted = clean.join(refused, "tag", "left_anti")
    pairs = pairs.join(refused, pairs["canonical_tag"] == refused["tag"], "left_anti")

    kept = aliases.join(accepted.select(F.col("tag").alias("canonical_tag")), "canonical_tag", "left_anti")
    moved = kept.join(pairs.select(F.col("alias").alias("canonical_tag"), F.col("canonical_tag").alias("_target")), "canonical_tag", "left")
    repointed = moved.select("alias", F.coalesce("_target", "canonical_tag").alias("canonical_tag"))
    new_aliases = repointed.join(pairs.select("alias"), "alias", "left_anti").unionByName(pairs)

    untouched = definitions.join(accepted.select("tag"), "tag", "left_anti").join(pairs.select(F.col("alias").alias("tag")), "tag", "left_anti")
    previous = definitions.select("tag", F.col("created_by").alias("_by"), F.col("created_at").alias("_at"))
    written = accepted.join(previous, "tag", "left").select(
        "tag",
        "kind",
        F.when(strip(F.col("display_name")) == "", F.col("tag")).otherwise(strip(F.col("display_name"))).alias("display_name"),
        "description",
        F.coalesce("_by", "created_by").alias("created_by"),
        F.coalesce("_at", F.lit(now).cast("timestamp_ntz")).alias("created_at"),
    )
    affected = page_tags.join(pairs.select(F.col("alias").alias("tag")), "tag", "left_semi").select("page_id").distinct()
    return {
        "definitions": untouched.select(written.columns).unionByName(written),
        "aliases": new_aliases,
        "page_tags": resolve_tag_rows(page_tags, pairs),
        "refused": refused,
        "reindex": affected,
    }


def delete_tag(pages: DataFrame, definitions: DataFrame, tag: str, everywhere: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages to update and the remaining definitions.

    Only live published pages lose the tag, unless `everywhere` is set.
    """
    name = tag.strip().lower()
    touched = pages if everywhere else active(pages).filter(F.col("status") == "published")
    updates = touched.filter(F.array_contains("tags", name)).withColumn("tags", F.array_remove("tags", name))
    return updates, definitions.filter(F.lower("tag") != name)


def parse_topics(replies: DataFrame, reply: str, keep: list[str], maximum: int = 3, minimum_confidence: float = 0.65) -> DataFrame:
    """(keep, topics, error): topics proposed by model replies, best first.

    A reply may carry a thinking block and a fenced JSON object. Entries of the
    wrong type or below the confidence gate are dropped; an unreadable reply gets
    an error instead.
    """
    replies = replies.withColumn("_cleaned", strip(F.regexp_replace(F.col(reply), r"(?is)<think>.*?</think>\s*", "")))
    cleaned = F.col("_cleaned")
    fenced = F.regexp_extract(cleaned, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    whole = F.when(cleaned.rlike(r"(?is)```(?:json)?\s*.*?\s*```"), fenced).otherwise(cleaned)
    braces = F.regexp_extract(cleaned, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.try_parse_json(whole), F.try_parse_json(F.when(braces != "", braces)))
    rows = replies.select(*keep, parsed.alias("_json"))
    entries = F.try_variant_get("_json", "$.topics", "array<variant>")
    confidence = lambda item: F.try_variant_get(item, "$.confidence", "double")

    def numeric(item: Column) -> Column:
        return F.schema_of_variant(F.try_variant_get(item, "$.confidence", "variant")).rlike("(?i)^(bigint|double|decimal|float|int)")

    def textual(item: Column, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING"

    valid = F.filter(
        F.slice(F.col("_entries"), 1, maximum),
        lambda item: F.coalesce(textual(item, "tag") & textual(item, "displayName") & numeric(item) & confidence(item).between(minimum_confidence, 1.0), F.lit(False)),
    )

    def topic(item: Column) -> Column:
        base = F.regexp_replace(F.lower(strip(F.try_variant_get(item, "$.tag", "string"))), "^topic:", "")
        identifier = F.rtrim(F.substring(slugify(base), 1, 54), F.lit("-"))
        label = F.substring(strip(F.regexp_replace(F.try_variant_get(item, "$.displayName", "string"), r"\s+", " ")), 1, 100)
        return F.struct(F.concat(F.lit("topic:"), identifier).alias("tag"), F.when(label == "", identifier).otherwise(label).alias("display_name"), confidence(item).alias("confidence"))

    read = rows.withColumn("_entries", entries)
    shaped = read.withColumn("topics", best_topics(F.transform(valid, topic), maximum))
    error = F.when(F.col("_json").isNull(), F.lit("classification response is not valid JSON")).when(F.col("_entries").isNull(), F.lit("classification response has no topics array"))
    return shaped.select(*keep, F.when(error.isNull(), F.col("topics")).alias("topics"), error.alias("error"))


def best_topics(topics: Column, maximum: int) -> Column:
    """Highest confidence per tag (first one on ties), then the best `maximum` in stable order."""
    placed = F.transform(topics, lambda item, position: F.struct((-item["confidence"]).alias("order"), position.alias("position"), item.alias("topic")))
    return bind(placed, lambda entries: _best(entries, maximum))


def _best(placed: Column, maximum: int) -> Column:
    best = F.filter(
        placed,
        lambda item: ~F.exists(
            placed,
            lambda other: (other["topic"]["tag"] == item["topic"]["tag"])
            & ((other["order"] < item["order"]) | ((other["order"] == item["order"]) & (other["position"] < item["position"]))),
        ),
    )
    # A tag keeps the place at which it was first proposed.
    anchored = F.transform(
        best,
        lambda item: F.struct(
            item["order"].alias("order"),
            F.array_min(F.transform(F.filter(placed, lambda other: other["topic"]["tag"] == item["topic"]["tag"]), lambda other: other["position"])).alias("position"),
            item["topic"].alias("topic"),
        ),
    )
    return F.transform(F.slice(F.array_sort(anchored, _by_order), 1, maximum), lambda item: item["topic"])


def _by_order(left: Column, right: Column) -> Column:
    return (
        F.when(left["order"] < right["order"], F.lit(-1))
        .when(left["order"] > right["order"], F.lit(1))
        .when(left["position"] < right["position"], F.lit(-1))
        .otherwise(F.lit(1))
    )


def merge_topics(proposed: Column, reconciled: Column, maximum: int) -> Column:
    return best_topics(F.concat(proposed, reconciled), maximum)


def merge_topic_rows(proposed: DataFrame, key: str, maximum: int) -> DataFrame:
    """(key, topics): the same merge over rows (key, tag, display_name, confidence, position), however many a key has.

    Rows are merged by tag before a key's topics come together.
    """
    best = proposed.groupBy(key, "tag").agg(F.max("confidence").alias("confidence"), F.min_by("display_name", F.struct(-F.col("confidence"), F.col("position"))).alias("display_name"), F.min("position").alias("position"))
    placed = top_per_group(best, key, maximum, F.desc("confidence"), F.asc("position"), rank="_rank")
    listed = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", "tag", "display_name", "confidence"))).alias("_topics"))
    return listed.select(key, F.transform("_topics", lambda item: F.struct(item["tag"].alias("tag"), item["display_name"].alias("display_name"), item["confidence"].alias("confidence"))).alias("topics"))


def reconciliation_candidates(definitions: DataFrame, previous: DataFrame, proposed: DataFrame) -> DataFrame:
    """(document_id, tag, display_name, aliases, usage_count): topics to be checked again.

    Topics nobody uses are candidates of every document; they come once, with a
    null document_id. Topics generated before or just proposed come with their
    document, unless nobody uses them. Whoever builds a prompt cuts the list.
    """
    topics = definitions.filter(F.col("kind") == "topic")
    columns = ["tag", "display_name", "aliases", "usage_count"]
    shared = topics.filter(F.col("usage_count") == 0).select(F.lit(None).cast(previous.schema["document_id"].dataType).alias("document_id"), *columns)
    named = previous.select("document_id", "tag").unionByName(proposed.select("document_id", "tag")).distinct()
    own = named.join(topics.filter(F.col("usage_count") != 0), "tag").select("document_id", *columns)
    return shared.unionByName(own)


def orphan_topics(contents: DataFrame, definitions: DataFrame, key: str, content: str) -> DataFrame:
    """(key, tag, display_name, confidence): unused topics whose name or alias stands in a text.

    A name counts as a whole phrase between characters that are neither letters
    nor digits. The different words of a text meet the names by their first word;
    a text then comes back once, to all names it may hold.
    """
    unused = definitions.filter((F.col("kind") == "topic") & (F.col("usage_count") == 0))
    own = F.replace(F.regexp_replace("tag", "^topic:", ""), F.lit("-"), F.lit(" "))
    names = unused.select("tag", "display_name", F.explode(F.array_distinct(F.concat(F.array(own), F.col("aliases")))).alias("name"))
    names = names.filter(F.length("name") >= 3).select("tag", "display_name", F.lower("name").alias("name"), F.try_element_at(words_of(F.lower("name")), F.lit(1)).alias("word"))
    texts = contents.select(key, F.lower(content).alias("_text"))
    words = texts.select(key, F.explode(F.array_distinct(words_of(F.col("_text")))).alias("word"))
    likely = words.join(names.filter(F.col("word").isNotNull()), "word").groupBy(key).agg(F.collect_set(F.struct("tag", "display_name", "name")).alias("_names"))
    surrounded = lambda item: F.concat(F.lit(r"(^|[^\p{L}\p{N}])\Q"), item["name"], F.lit(r"\E($|[^\p{L}\p{N}])"))
    held = F.filter("_names", lambda item: F.regexp_like(F.col("_text"), surrounded(item)))
    found = texts.join(likely, key).select(key, F.explode(F.array_distinct(F.transform(held, lambda item: F.struct(item["tag"].alias("tag"), item["display_name"].alias("display_name"))))).alias("_topic"))
    return found.select(key, "_topic.tag", "_topic.display_name", F.lit(1.0).alias("confidence"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def apply_generated_tags(page_tags: DataFrame, generated: DataFrame, suppressed: DataFrame, topics: DataFrame, aliases: DataFrame, definitions: DataFrame | None = None, now: str | None = None) -> dict[str, DataFrame]:
    """Replace generated tags of the pages in `topics` (page_id, tag, confidence, display_name).

    Tags set by people stay; a topic is added unless people set it already or
    took it away before. `generated` comes back whole, other pages included, so it
    can be stored as it is. With `definitions`, topics not defined yet are added
    to them. `managed_tags` are the tags of the touched pages.

    All rows of a (page, tag) meet once, as flags.
    """
    names = aliases.select(F.col("alias").alias("tag"), "canonical_tag")
    canonical = topics.join(names, "tag", "left").select("page_id", F.coalesce("canonical_tag", "tag").alias("tag"), "confidence")
    none = F.lit(None).cast("double")
    known = F.col("confidence").cast("double") if "confidence" in generated.columns else none
    parts = [
        page_tags.select("page_id", "tag", F.lit(1).alias("kind"), none.alias("value")),
        generated.select("page_id", "tag", F.lit(2).alias("kind"), known.alias("value")),
        suppressed.select("page_id", "tag", F.lit(3).alias("kind"), none.alias("value")),
        canonical.select("page_id", "tag", F.lit(4).alias("kind"), F.col("confidence").cast("double").alias("value")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    has = lambda kind: F.bool_or(F.col("kind") == kind)
    flags = rows.groupBy("page_id", "tag").agg(
        has(1).alias("on_page"), has(2).alias("was_generated"), has(3).alias("was_suppressed"), has(4).alias("proposed"),
        F.max(F.when(F.col("kind") == 4, F.col("value"))).alias("new_value"), F.max(F.when(F.col("kind") == 2, F.col("value"))).alias("old_value"),
    )
    touched = topics.select("page_id").distinct()
    state = flags.join(touched.withColumn("_touched", F.lit(True)), "page_id", "left").withColumn("_touched", F.coalesce("_touched", F.lit(False)))
    human = F.col("on_page") & ~F.col("was_generated")
    fresh = F.col("proposed") & ~human & ~F.col("was_suppressed")
    kept = ~F.col("_touched") & F.col("was_generated")
    new_tags = state.filter(human | fresh | (kept & F.col("on_page"))).select("page_id", "tag", "_touched")
    result = {
        "page_tags": new_tags.select("page_id", "tag"),
        "generated": state.filter(fresh | kept).select("page_id", "tag", F.when(fresh, F.col("new_value")).otherwise(F.col("old_value")).alias("confidence")),
        "managed_tags": new_tags.filter("_touched").groupBy("page_id").agg(F.array_sort(F.collect_set("tag")).alias("tags")),
        "reindex": touched,
    }
    if definitions is not None:
        named = topics.groupBy("tag").agg(F.min("display_name").alias("display_name"))
        added = named.join(definitions.select("tag"), "tag", "left_anti").select(
            "tag", F.lit("topic").alias("kind"), "display_name", F.lit(None).cast("string").alias("description"), F.lit("model").alias("created_by"), F.lit(now).cast("timestamp_ntz").alias("created_at")
        )
        result["definitions"] = definitions.select(added.columns).unionByName(added)
    return result


def reconcile_edits(generated: DataFrame, suppressed: DataFrame, submitted: DataFrame, edited: DataFrame) -> dict[str, DataFrame]:
    """Effect of people's tag edits on generated tags.

    `edited` lists the pages whose tags were submitted, `submitted` their tags. A
    generated tag left out becomes suppressed; a submitted tag is no longer.
    """
    removed = generated.join(edited, "page_id", "left_semi").join(submitted, ["page_id", "tag"], "left_anti").select("page_id", "tag")
    return {
        "generated": generated.join(removed, ["page_id", "tag"], "left_anti"),
        "suppressed": suppressed.select("page_id", "tag").unionByName(removed).distinct().join(submitted, ["page_id", "tag"], "left_anti"),
    }
