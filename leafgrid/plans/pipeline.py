"""The whole way from responses to tables of results, for users of the library."""

from pyspark.sql import DataFrame

from leafgrid.operators import paging, reports, tables


def complete_responses(responses: DataFrame, documents: DataFrame, chunk_pages: int) -> DataFrame:
    """Responses with their page offset, the latest one of each chunk (``received_at``);
    documents with lost or unplanned chunks are left out whole."""
    plan = paging.chunk_plan(documents, chunk_pages)
    failed = paging.missing_chunks(plan, responses).filter("failed")
    responses = paging.latest_responses(responses)
    return paging.with_offsets(responses, plan).join(failed.select("doc_id"), "doc_id", "left_anti")


def extract(elements: DataFrame, documents: DataFrame, keep=lambda df, name: df) -> dict[str, DataFrame]:
    """All result tables of a corpus, each lazy.  Store ``elements`` before (as Parquet).

    All reports are made from the same rows of assets; ``keep(df, name)`` may store those once
    (``session.stage`` does, ``session.clear_stages`` removes them at the end).
    """
    assets = keep(tables.visuals(elements, figures=True, notes=True), "assets")
    flags = reports.asset_flags(assets)
    return {
        "assets": reports.asset_list(assets),
        "figures": assets.filter("prefix = 'f'").select(
            "doc_id", "seq", "index", "page", "figure_type", "description", "caption"
        ),
        "footnotes": assets.filter("prefix = 'n'").select("doc_id", "seq", "page", "markdown"),
        "boundary_cases": tables.boundary_cases(assets),
        "cells": tables.typed_cells(tables.table_cells(tables.table_grids(elements))),
        "counts": reports.document_counts(documents, elements, flags),
        "page_map": reports.page_map(documents, elements, flags),
        "index": reports.index_rows(assets),
        "meta": reports.document_meta(documents, assets),
    }
