"""One object over the archive's tables, with the questions people ask of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import SectionFilters, Settings
from .operators import answering, blobs, chunks, filters, graph, history, hybrid, lexical, paging, taxonomy, tree, vectors
from .sources import tables


@dataclass
class Archive:
    """Tables are DataFrames with the columns of `model.PAGES` and the operators' docstrings.

    Only `pages` is required; what a question needs beyond it must be given.
    """

    pages: DataFrame
    sections: DataFrame | None = None
    versions: DataFrame | None = None
    documents: DataFrame | None = None
    revisions: DataFrame | None = None
    page_chunks: DataFrame | None = None
    section_chunks: DataFrame | None = None
    definitions: DataFrame | None = None
    aliases: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: str | None = None, **more) -> "Archive":
        """The published version of every known table in a folder."""
        chosen = version or tables.current_version(spark, folder)
        names = ("pages", "sections", "versions", "documents", "revisions", "page_chunks", "section_chunks", "definitions", "aliases")
        found = {}
        for name in names:
            try:
                found[name] = tables.open_version(spark, folder, name, chosen)
            except Exception as problem:  # a table that was never published stays unset
                if "PATH_NOT_FOUND" not in str(problem):
                    raise
        return cls(**found, **more)

    @property
    def links(self) -> DataFrame:
        return graph.link_rows(self.pages)

    @property
    def searchable(self) -> DataFrame | None:
        if self.sections is None:
            return None
        return filters.searchable_sections(self.sections, self.versions, self.documents, self.pages)

    def resolve(self, tags: list[str]) -> list[str]:
        return list(tags) if self.aliases is None else taxonomy.resolve_tags(list(tags), self.aliases)

    def page(self, page: int | str) -> DataFrame:
        return filters.page_by_id(self.pages, page) if isinstance(page, int) else filters.page_by_alias(self.pages, page)

    def list(self, cursor: str | None = None, limit: int = 50, status: str = "published") -> tuple[list, str | None]:
        return paging.take_keyset(paging.list_pages(self.pages, cursor, limit, status), limit)

    def trash(self, cursor: str | None = None, limit: int = 50) -> tuple[list, str | None]:
        return paging.take_keyset(paging.list_trash(self.pages, cursor, limit), limit)

    def recent(self, limit: int = 20, status: str = "published") -> DataFrame:
        return paging.recent(self.pages, limit, status)

    def search_pages(self, query: str, tags=(), status: str = "published", properties: dict | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        return lexical.search_pages(self.pages, query, self.resolve(tags), status, properties, limit, offset)

    def search(self, query: str, tags=(), status: str = "published", properties: dict | None = None, facets: SectionFilters = SectionFilters(), vector: list[float] | None = None, cursor: str | None = None, limit: int = 20) -> dict:
        """One page of fused hits with the next cursor, the mode that was used, and a warning if any."""
        searchable = self.searchable
        if searchable is None:
            facets = SectionFilters(source="pages")
        chosen = self.resolve(tags)
        if vector is not None:
            vector = vectors.check_query_vector(vector, self.settings.embedding_dimensions)
        hits, mode, warning = hybrid.search(self.pages, searchable, query, chosen, status, properties, facets, vector, self.page_chunks, self.section_chunks)
        rows, following = hybrid.take_hits(hits, cursor, limit, mode, query=query, tags=chosen, status=status, properties=properties or {}, facets=facets)
        return {"hits": rows, "next_cursor": following, "mode": mode, "warning": warning}

    def evidence_for(self, question: str, tags=(), status: str = "published", properties: dict | None = None, facets: SectionFilters = SectionFilters(), vector: list[float] | None = None) -> DataFrame:
        """Numbered evidence for a question from pages and sections: the whole question first, else its keywords one by one."""
        if vector is not None:
            vector = vectors.check_query_vector(vector, self.settings.embedding_dimensions)
        searchable, limit = self.searchable, self.settings.max_evidence_items
        hits, _, _ = answering.retrieve(self.pages, searchable, question, self.resolve(tags), status, properties, facets, limit, vector, self.page_chunks, self.section_chunks)
        return answering.evidence(hits, self.pages, searchable, limit, self.settings.max_evidence_chars, self.settings.max_prompt_chars)

    def tree(self, status: str = "published") -> DataFrame:
        return tree.tree(self.pages, status)

    def breadcrumbs(self) -> DataFrame:
        return tree.breadcrumbs(self.pages)

    def children(self, page_id: int) -> DataFrame:
        return graph.children(self.pages, page_id)

    def outgoing(self, page_id: int) -> DataFrame:
        return graph.outgoing_links(graph.link_rows(self.pages.filter(F.col("id") == page_id)), self.pages, page_id)

    def backlinks(self) -> DataFrame:
        return graph.backlinks(self.links, self.pages)

    def backlink_list(self) -> DataFrame:
        return graph.backlink_list(self.links, self.pages)

    def related(self, page_id: int, limit: int = 8) -> DataFrame:
        return graph.related(self.pages, page_id, limit)

    def explore(self, limit: int = 10) -> dict[str, DataFrame]:
        return graph.explore(self.links, self.pages, limit)

    def tags(self) -> DataFrame:
        return taxonomy.tag_counts(self.pages)

    def definitions_in_use(self) -> DataFrame:
        return taxonomy.definition_usage(self.definitions, filters.tag_rows(self.pages), self.aliases)

    def compare(self) -> DataFrame:
        return history.compare_revisions(self.revisions, self.pages)

    def chunks(self) -> DataFrame:
        return chunks.page_chunks(self.pages, self.settings.chunk_chars, self.settings.chunk_overlap)

    def statistics(self, stored: DataFrame, **more: DataFrame) -> DataFrame:
        counted = {"active_pages": filters.active(self.pages), "deleted_pages": filters.deleted(self.pages), **more}
        for name in ("revisions", "documents", "sections"):
            if getattr(self, name) is not None:
                counted[name] = getattr(self, name)
        return blobs.statistics(counted, stored)
