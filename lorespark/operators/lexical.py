"""Ranked full-text search: prefix phrases joined by AND, scored by BM25.

Two plans give the same scores. `scan_search` counts matches while it scans the
texts and needs no index. `PostingsIndex` keeps one row per (document, text,
term), so that a query, or a whole table of queries, reads only its terms;
`SegmentedIndex` keeps such an index up to date.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.cursors import strict_limit
from ..functions.text import DROPPED_MARKS, excerpt, fold, keyword_fold, spaced_tokens, tokens, tokens_of_string
from ..model import CANDIDATES_PER_LIST, SectionFilters
from ..session import written
from ..sources.segments import SegmentedTable
from .filters import active, json_text, with_all_tags, with_facets, with_properties, with_status
from .scale import one_row, top_per_group

# BM25 parameters and the floor of the inverse document frequency.
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6
PAGE_TEXTS = ["title", "alias", "body", "tags_text", "properties_text"]
SECTION_TEXTS = ["filename", "page_title", "section_title", "kind", "locator_text", "text"]
SNIPPET_TOKENS = 32
#: Stands where a snippet leaves something out.
CUT_MARK = " … "
# Words that never count as keywords of a question.
STOPWORDS = (
    "a", "al", "and", "are", "as", "at", "be", "by", "como", "con", "cual", "cuales", "cuanto", "cuantos", "de", "del",
    "do", "does", "el", "en", "es", "for", "from", "hay", "how", "is", "la", "las", "los", "of", "para", "por", "qué",
    "que", "the", "to", "un", "una", "what", "when", "where", "which", "who", "why",
)
MAX_KEYWORDS = 12


def page_index_rows(pages: DataFrame) -> DataFrame:
    """Pages with the two derived texts that are searched besides title, alias and body."""
    pairs = F.transform(F.map_entries("properties"), lambda item: F.concat_ws(" ", item["key"], json_text(item["value"])))
    return pages.withColumn("tags_text", F.array_join("tags", " ")).withColumn("properties_text", F.array_join(pairs, " "))


def section_index_rows(sections: DataFrame) -> DataFrame:
    """Searchable sections with the derived texts that are searched besides file, title, kind and content."""
    return sections.withColumn("section_title", F.coalesce("title", F.lit(""))).withColumn("locator_text", F.to_json("locator"))


def parse_query(query: str) -> list[list[str]]:
    """Each word becomes a phrase of tokens whose last token is a prefix."""
    return [tokens_of_string(word) for word in query.split()]


def phrase_hits(words: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in a token array; an empty phrase never occurs."""
    if not phrase:
        return F.lit(0)
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda word: word.startswith(phrase[0])))

    def starts_here(word: Column, position: Column) -> Column:
        here = word == phrase[0]
        for step, token in enumerate(phrase[1:-1], start=1):
            here = here & (F.get(words, position + step) == token)
        return here & F.coalesce(F.get(words, position + len(phrase) - 1).startswith(phrase[-1]), F.lit(False))

    return F.size(F.filter(words, starts_here))


def _sum(columns: list[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


def count_matches(rows: DataFrame, texts: list[str], phrases: list[list[str]], keep: list[str]) -> DataFrame:
    """Per row: kept columns, length in tokens, and hits of each phrase over all its texts.

    Each text is tokenised once: its counts leave one bound expression as a
    struct, and a generator keeps later filters from copying that expression.
    """
    names = ["length", *[f"hits_{index}" for index in range(len(phrases))]]

    def count(words: Column) -> Column:
        return F.struct(F.size(words).alias("length"), *[phrase_hits(words, phrase).alias(name) for name, phrase in zip(names[1:], phrases)])

    counts = F.transform(F.array(*[F.col(name) for name in texts]), lambda text: bind(tokens(text), count))

    def total(found: Column) -> Column:
        return F.struct(*[_sum([F.get(found, F.lit(number))[name] for number in range(len(texts))]).alias(name) for name in names])

    return rows.select(*keep, F.inline(F.array(bind(counts, total))))


def inverse_frequency(total: Column, containing: Column) -> Column:
    value = F.ln((total - containing + 0.5) / (containing + 0.5))
    return F.when(value > 0, value).otherwise(F.lit(MIN_IDF))


def bm25_part(hits: Column, length: Column, average: Column) -> Column:
    return hits * (K1 + 1) / (hits + K1 * (1 - B + B * length / average))


def scan_scores(rows: DataFrame, texts: list[str], query: str, keep: list[str]) -> DataFrame:
    """Matching rows with their BM25 score (lower is better), by scanning the texts.

    The texts are read and tokenised in a single pass, which writes the matching
    rows alone; the statistics of all rows are observed on the way. The result
    also holds the hits of each phrase. `keep` should hold no long texts.
    """
    phrases = parse_query(query)
    seen = Observation()
    counted = count_matches(rows, texts, phrases, keep).observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("length").cast("long")).alias("tokens"),
        *[F.count_if(F.col(f"hits_{index}") > 0).alias(f"containing_{index}") for index in range(len(phrases))],
    )
    for index in range(len(phrases)):
        counted = counted.filter(F.col(f"hits_{index}") > 0)
    matching = written(counted)
    corpus = seen.get
    total, average = F.lit(corpus["total"]), F.lit((corpus["tokens"] or 0) / max(1, corpus["total"]))
    parts = [
        inverse_frequency(total, F.lit(corpus[f"containing_{index}"])) * bm25_part(F.col(f"hits_{index}"), F.col("length"), average) for index in range(len(phrases))
    ]
    return matching.select(*keep, "length", *[f"hits_{index}" for index in range(len(phrases))], (-_sum(parts)).alias("score"))


def rank_pages(
    pages: DataFrame, query: str, tags: list[str] = (), status: str = "published", properties: dict | None = None, limit: int = CANDIDATES_PER_LIST, offset: int = 0
) -> DataFrame:
    """(id, score, updated_at) of the best pages; without words, of the most recently updated pages.

    Frequencies and lengths are those of all live pages, as the index covers
    every status; the filters apply to the matches.
    """
    live = active(pages)
    filter_columns = ["id", "status", "tags", "properties", "updated_at"]
    words = bool(query.strip())
    if words:
        ranked = scan_scores(page_index_rows(live), PAGE_TEXTS, query, filter_columns)
    else:
        ranked = live.select(*filter_columns, F.lit(0.0).alias("score"))
    kept = with_properties(with_all_tags(with_status(ranked, status), list(tags)), properties or {})
    return kept.orderBy(*page_order(query)).offset(offset).limit(strict_limit(limit)).select("id", "score", "updated_at")


def page_order(query: str) -> list[Column]:
    return [F.asc("score"), F.desc("id")] if query.strip() else [F.desc("updated_at"), F.desc("id")]


def search_pages(
    pages: DataFrame, query: str, tags: list[str] = (), status: str = "published", properties: dict | None = None, limit: int = CANDIDATES_PER_LIST, offset: int = 0
) -> DataFrame:
    """The pages of `rank_pages` with their summary and an excerpt."""
    top = rank_pages(pages, query, tags, status, properties, limit, offset).select("id", "score")
    shown = _rows_of(active(pages), "id", top).select("id", "title", "alias", "tags", "status", "parent_id", "created_at", "updated_at", excerpt(F.col("body")).alias("excerpt"), "score")
    return shown.orderBy(*page_order(query))


def rank_sections(
    searchable: DataFrame, query: str, filters: SectionFilters = SectionFilters(), tags: list[str] = (), status: str = "published", properties: dict | None = None, limit: int = CANDIDATES_PER_LIST
) -> DataFrame:
    """(section_id, page_id, score, document_updated_at) of the best sections under all facets."""
    rows = section_index_rows(searchable)
    facets = ["section_id", "page_id", "document_id", "version", "format", "kind", "hidden", "ocr_status", "document_updated_at", "page_status", "tags", "properties"]
    words = bool(query.strip())
    if words:
        ranked = scan_scores(rows, SECTION_TEXTS, query, facets)
    else:
        ranked = rows.select(*facets, F.lit(0.0).alias("score"))
    kept = with_facets(ranked, filters, list(tags), status, properties)
    return kept.orderBy(*section_order(query)).limit(strict_limit(limit)).select("section_id", "page_id", "score", "document_updated_at")


def section_order(query: str) -> list[Column]:
    return [F.asc("score"), F.desc("section_id")] if query.strip() else [F.desc("document_updated_at"), F.desc("section_id")]


def search_sections(
    searchable: DataFrame, query: str, filters: SectionFilters = SectionFilters(), tags: list[str] = (), status: str = "published", properties: dict | None = None, limit: int = CANDIDATES_PER_LIST
) -> DataFrame:
    """The sections of `rank_sections` with their place and an excerpt; `searchable` comes from `searchable_sections`."""
    top = rank_sections(searchable, query, filters, tags, status, properties, limit).select("section_id", "score")
    text = snippet(F.col("text"), parse_query(query)) if query.strip() else F.substring("text", 1, 500)
    shown = _rows_of(searchable, "section_id", top).select(
        "section_id", "ordinal", "document_id", "version_id", "version", "page_id", "filename", "format", "kind", "locator", "hidden",
        "ocr_status", "document_updated_at", text.alias("excerpt"), "score",
    )
    return shown.orderBy(*section_order(query))


def _rows_of(rows: DataFrame, key: str, top: DataFrame) -> DataFrame:
    """Full rows of a short ranked list.

    The list is at most one page of results long, so its keys become a filter
    that the scan can use to skip row groups, and the list itself is broadcast.
    """
    found = top.collect()
    short = rows.sparkSession.createDataFrame(found, top.schema)
    return rows.filter(F.col(key).isin([row[key] for row in found])).join(F.broadcast(short), key)


#: What a window gains: for each phrase in it, for a begin at a sentence, for one at the text's own begin.
PHRASE_GAIN, SENTENCE_GAIN, BEGIN_GAIN = 1000, 100, 120


def snippet(text: Column, phrases: list[list[str]], size: int = SNIPPET_TOKENS) -> Column:
    """The window of `size` tokens that covers the phrases best, as it stands in the text, with cut marks.

    A window begins at an occurrence of a phrase, or at the sentence that holds
    one. Each different phrase inside counts PHRASE_GAIN, each further occurrence
    one, a sentence's begin SENTENCE_GAIN and that of the text BEGIN_GAIN; of equal
    windows the first candidate wins. A window that begins at an occurrence is
    moved so that what it found lies in its middle. Without any occurrence the text's
    begin is shown.
    """
    letters = rf"[\p{{L}}\p{{N}}\p{{Co}}{DROPPED_MARKS}]"
    others = letters.replace("[", "[^", 1)
    wanted = [phrase for phrase in phrases if phrase]

    def shown(pieces: Column) -> Column:
        count = F.size(pieces)
        words = F.transform(pieces, lambda piece: fold(F.regexp_extract(piece, f"^{letters}+", 0)))
        return bind(words, lambda tokens_: bind(start_of(tokens_, pieces), lambda start: cut(start, pieces, count)))

    def start_of(words: Column, pieces: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1)

        def of_phrase(number: int, phrase: list[str]) -> Column:
            here = lambda at: phrase_at(words, at, phrase)
            return F.transform(F.filter(places, here), lambda at: F.struct(at.alias("at"), F.lit(number).alias("phrase"), (at + len(phrase)).alias("end")))

        if not wanted:
            return F.lit(0)
        found = F.array_sort(F.concat(*[of_phrase(number, phrase) for number, phrase in enumerate(wanted)]))
        # A sentence begins after a full stop or a colon.
        begins = F.filter(places, lambda at: (at == 0) | F.get(pieces, at - 1).rlike(r"[.:][^.:]*$"))
        return bind(F.struct(found.alias("found"), begins.alias("begins")), lambda both: F.when(F.size(both["found"]) > 0, best(both["found"], both["begins"], F.size(words))).otherwise(F.lit(0)))

    def inside(found: Column, start: Column) -> Column:
        return F.filter(found, lambda one: (one["at"] >= start) & (one["at"] < start + size))

    def gain(held: Column) -> Column:
        different = F.size(F.array_distinct(F.transform(held, lambda one: one["phrase"])))
        return different * PHRASE_GAIN + F.size(held) - different

    def middle(held: Column, count: Column) -> Column:
        first, last = F.get(held, F.lit(0))["at"], F.array_max(F.transform(held, lambda one: one["end"]))
        return F.greatest(F.least(first - F.floor((F.lit(size) - (last - first)) / 2).cast("int"), count - size), F.lit(0))

    def best(found: Column, begins: Column, count: Column) -> Column:
        def candidates(one: Column, order: Column) -> Column:
            at = one["at"]
            sentence = F.array_max(F.filter(begins, lambda begin: begin <= at))
            extra = F.when(sentence == 0, BEGIN_GAIN).otherwise(SENTENCE_GAIN)
            own = bind(inside(found, at), lambda held: F.struct(gain(held).alias("gain"), (-2 * order).alias("order"), middle(held, count).alias("start")))
            whole = F.struct((gain(inside(found, sentence)) + extra).alias("gain"), (-2 * order - 1).alias("order"), sentence.alias("start"))
            return F.array(own, F.when(sentence < at, whole).otherwise(own))

        return F.array_max(F.flatten(F.transform(found, candidates)))["start"]

    def cut(start: Column, pieces: Column, count: Column) -> Column:
        end = F.least(start + size, count)
        head = F.when(start == 0, F.regexp_extract(text, f"^{others}*", 0)).otherwise(F.lit(CUT_MARK))
        body = F.array_join(F.slice(pieces, start + 1, F.greatest(end - start, F.lit(1))), "")
        return F.concat(head, F.when(end < count, F.concat(F.regexp_replace(body, f"{others}+$", ""), F.lit(CUT_MARK))).otherwise(body))

    pieces = F.regexp_extract_all(text, F.lit(f"{letters}+{others}*"), F.lit(0))
    return bind(pieces, lambda some: F.when(F.size(some) > 0, shown(some)).otherwise(text))


def phrase_at(words: Column, at: Column, phrase: list[str]) -> Column:
    """Whether a phrase, its last token a prefix, stands at a place of a token array."""
    here = F.lit(True)
    for step, token in enumerate(phrase[:-1]):
        here = here & F.coalesce(F.get(words, at + step) == token, F.lit(False))
    return here & F.coalesce(F.get(words, at + len(phrase) - 1).startswith(phrase[-1]), F.lit(False))


@dataclass(frozen=True)
class PostingsIndex:
    """postings(id, text_no, term, hits[, positions]) and lengths(id, length).

    Positions are needed for phrases of several tokens only.
    """

    postings: DataFrame
    lengths: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, texts: list[str], key: str = "id", positions: bool = False) -> "PostingsIndex":
        """Postings of every row, written once: every use of the index reads them, and no text again.

        Each task sorts the postings of its own rows by term, so a prefix reads a few
        pages of every file; nothing is shuffled, and no text is tokenised for a
        sample of the terms.
        """
        return cls.of(written(index_rows(rows, texts, key, positions).sortWithinPartitions("term", "id")))

    @classmethod
    def of(cls, rows: DataFrame) -> "PostingsIndex":
        """The index in rows of `index_rows`."""
        return cls(rows.filter(F.col("term") != ""), rows.filter(F.col("term") == "").select("id", F.col("hits").alias("length")))

    def save(self, folder: str) -> "PostingsIndex":
        """Write both tables, postings sorted by term."""
        _by_term(self.postings).write.mode("overwrite").parquet(f"{folder}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
        return self.load(self.postings.sparkSession, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "PostingsIndex":
        return cls(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"))

    def phrase_matches(self, phrase: list[str]) -> DataFrame:
        """(id, hits) of one phrase. Longer phrases meet on consecutive positions."""
        last = self.postings.filter(_has_prefix("term", phrase[-1]))
        if len(phrase) == 1:
            return last.groupBy("id").agg(F.sum("hits").alias("hits"))
        ends = last.groupBy("id", "text_no").agg(F.flatten(F.collect_list("positions")).alias("ends"))
        shifted = F.transform("ends", lambda position: position - (len(phrase) - 1))
        starts = ends.select("id", "text_no", shifted.alias("starts"))
        for step, token in enumerate(phrase[:-1]):
            exact = self.postings.filter(F.col("term") == token).select("id", "text_no", F.transform("positions", lambda position: position - step).alias("here"))
            starts = starts.join(exact, ["id", "text_no"]).select("id", "text_no", F.array_intersect("starts", "here").alias("starts"))
        return starts.filter(F.size("starts") > 0).groupBy("id").agg(F.sum(F.size("starts")).alias("hits"))

    def scores(self, query: str) -> DataFrame:
        """(id, score) of every match of all phrases."""
        phrases = parse_query(query)
        if not phrases or not all(phrases):
            return self.lengths.filter(F.lit(False)).select("id", F.lit(0.0).alias("score"))
        corpus = one_row(self.lengths.agg(F.count("*").alias("total"), F.avg("length").alias("average")))
        matched, containing = None, []
        for index, phrase in enumerate(phrases):
            hits = self.phrase_matches(phrase)
            containing.append(one_row(hits.agg(F.count("*").alias("rows")))["rows"])
            hits = hits.withColumnRenamed("hits", f"hits_{index}")
            matched = hits if matched is None else matched.join(hits, "id")
        scored = matched.join(self.lengths, "id").withColumn("_corpus", corpus)
        for index in range(len(phrases)):
            scored = scored.withColumn(f"_containing_{index}", containing[index])
        parts = [
            inverse_frequency(F.col("_corpus.total"), F.col(f"_containing_{index}")) * bm25_part(F.col(f"hits_{index}"), F.col("length"), F.col("_corpus.average"))
            for index in range(len(phrases))
        ]
        return scored.select("id", (-_sum(parts)).alias("score"))

    def keyword_scores(self, keywords: DataFrame, limit: int) -> DataFrame:
        """Best `limit` rows of every keyword of a table: (keyword, id, score, rank).

        A keyword matches as a prefix. Prefixes meet the vocabulary, not the
        postings: a vocabulary term is expanded to its own prefixes, and the
        resulting (keyword, term) pairs join the postings on the term.
        """
        wanted = keywords.select("keyword").distinct()
        # No prefix longer than the longest keyword can match.
        longest = one_row(wanted.agg(F.coalesce(F.max(F.length("keyword")), F.lit(1)).alias("chars")))["chars"]
        vocabulary = self.postings.select("term").distinct().withColumn("_longest", longest)
        sizes = F.sequence(F.lit(1), F.least(F.length("term"), F.col("_longest")))
        prefixes = vocabulary.select("term", F.explode(sizes).alias("size")).select(
            "term", F.substring(F.col("term"), F.lit(1), F.col("size")).alias("keyword")
        )
        pairs = prefixes.join(wanted, "keyword")
        # Written once, as the counts and the scores both need all hits.
        hits = written(self.postings.join(pairs, "term").groupBy("keyword", "id").agg(F.sum("hits").alias("hits")))
        containing = hits.groupBy("keyword").agg(F.count("*").alias("containing"))
        corpus = one_row(self.lengths.agg(F.count("*").alias("total"), F.avg("length").alias("average")))
        scored = hits.join(containing, "keyword").join(self.lengths, "id").withColumn("_corpus", corpus)
        score = -inverse_frequency(F.col("_corpus.total"), F.col("containing")) * bm25_part(F.col("hits"), F.col("length"), F.col("_corpus.average"))
        ranked = scored.select("keyword", "id", F.round(score, 12).alias("score"))
        return top_per_group(ranked, "keyword", limit, F.asc("score"), F.desc("id"))


def index_rows(rows: DataFrame, texts: list[str], key: str = "id", positions: bool = False) -> DataFrame:
    """(id, text_no, term, hits[, positions]) of every row, and one with an empty term whose hits are the row's length.

    Every text is tokenised once, and its equal terms are counted where they are:
    numbered over a batch, (row, term) pairs are integers, and each is a run in
    their order. Rows without any token count in the statistics too.
    """
    kind = rows.schema[key].dataType.simpleString()
    words = rows.select(F.col(key).alias("id"), *[F.coalesce(spaced_tokens(F.col(text)), F.lit("")).alias(f"_words_{number}") for number, text in enumerate(texts)])
    schema = f"id {kind}, text_no int, term string, hits bigint" + (", positions array<int>" if positions else "")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield from _counted(part, positions)

    return words.mapInArrow(count, schema)


#: Bytes of text whose terms are counted at once; a single longer row is counted alone.
SLICE_BYTES = 1 << 21


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = sum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) for column in batch.columns[1:])
    upto, first = np.append(0, np.cumsum(sizes)), 0
    while first < len(batch):
        after = max(first + 1, int(np.searchsorted(upto, upto[first] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(first, after - first)
        first = after


def _counted(batch: pa.RecordBatch, positions: bool) -> Iterator[pa.RecordBatch]:
    ids, lengths = batch.column(0), np.zeros(len(batch), np.int64)
    for number, column in enumerate(batch.columns[1:]):
        lists = pc.split_pattern(column, " ")
        words, owners = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.not_equal(words, "")
        coded, owners = words.filter(full).dictionary_encode(), owners.filter(full).to_numpy().astype(np.int64)
        counts = np.bincount(owners, minlength=len(batch))
        lengths += counts
        terms = max(len(coded.dictionary), 1)
        pairs = owners * terms + coded.indices.to_numpy()
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        found = pairs[starts]
        columns = [ids.take(pa.array(found // terms)), pa.array(np.full(len(found), number, np.int32)), coded.dictionary.take(pa.array(found % terms)), pa.array(np.diff(np.append(starts, len(pairs))))]
        if positions:
            places = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)).astype(np.int32)), pa.array(places[order].astype(np.int32))))
        yield pa.RecordBatch.from_arrays(columns, _POSTING[: len(columns)])
    rest = [pa.array(np.full(len(batch), -1, np.int32)), pa.array([""] * len(batch), pa.string()), pa.array(lengths)]
    nowhere = [pa.array([[]] * len(batch), pa.list_(pa.int32()))] if positions else []
    yield pa.RecordBatch.from_arrays([ids, *rest, *nowhere], _POSTING[: 4 + len(nowhere)])


_POSTING = ["id", "text_no", "term", "hits", "positions"]


class SegmentedIndex:
    """An index that follows its rows: changed and removed rows become a small segment, and searches read all of them.

    Scores are those of an index built afresh from the rows as they are now.
    """

    def __init__(self, spark: SparkSession, folder: str, texts: list[str], key: str = "id", positions: bool = False) -> None:
        self.texts, self.key, self.positions = texts, key, positions
        schema = "id bigint, text_no int, term string, hits bigint" + (", positions array<int>" if positions else "")
        # A prefix is a range of terms; tombstones have no term and stand first.
        self.table = SegmentedTable(spark, folder, schema, "id", ["term", "id"], F.col("term") == "")

    def update(self, changed: DataFrame | None = None, removed: DataFrame | None = None, batch: int | None = None) -> bool:
        """New and changed rows (each key once) and the keys of removed ones; False if this batch had come before."""
        rows = None if changed is None else index_rows(changed, self.texts, self.key, self.positions)
        gone = None if removed is None else removed.select(F.col(self.key).alias("id"))
        return self.table.append(rows, gone, batch)

    def open(self) -> PostingsIndex:
        """The index as it is now."""
        return PostingsIndex.of(self.table.read())


def _by_term(postings: DataFrame) -> DataFrame:
    """Sorted so that prefix ranges skip row groups; a frequent term may span several partitions."""
    return postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def _has_prefix(column: str, prefix: str) -> Column:
    """Prefix test that a Parquet scan turns into a range of row groups."""
    return F.col(column).startswith(prefix)


def question_keywords(questions: DataFrame, text: str = "text") -> DataFrame:
    """(question columns, keyword_no, keyword): up to twelve distinct words of a question, in order."""
    words = F.regexp_extract_all(keyword_fold(F.col(text)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    kept = F.slice(F.filter(F.array_distinct(words), lambda word: ~word.isin(*STOPWORDS)), 1, MAX_KEYWORDS)
    return questions.select(*[name for name in questions.columns if name != text], F.posexplode(kept).alias("keyword_no", "keyword"))


def keyword_vote(index: PostingsIndex, questions: DataFrame, question: str, text: str, limit: int) -> DataFrame:
    """Search every keyword on its own and rank rows by the number of keywords that found them.

    Ties go to the better single rank, then to the row that an earlier keyword
    found first. At most `limit` rows per keyword take part, which is part of
    the method.
    """
    keywords = question_keywords(questions.select(question, text), text)
    found = keywords.join(index.keyword_scores(keywords, limit), "keyword")
    votes = found.groupBy(question, "id").agg(
        F.count("*").alias("votes"), (F.min("rank") - 1).alias("best_rank"), F.min(F.struct("keyword_no", "rank")).alias("_first")
    )
    return top_per_group(votes, question, limit, F.desc("votes"), F.asc("best_rank"), F.asc("_first")).drop("_first")
