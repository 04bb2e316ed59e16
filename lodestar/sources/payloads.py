"""Landed payload pages of the JSON families as one row for each record.

A page is a row of portal_url, language, url_template, page (its number in the run) and body
(the JSON text). Records keep pos, their place on the page, so that keep-first rules have
an order. A page of another shape has no records here; see bad_pages().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import variants as V

PAGE = ["portal_url", "language", "url_template", "page"]


def _lists(root: Column) -> dict[str, Column]:
    either = F.when(V.is_list(root), V.list_of(root)).otherwise(V.list_of(V.at(root, "dataset")))
    return {
        "ckan": F.when(F.try_variant_get(root, "$.success", "boolean"), V.list_of(V.at(root, "result.results"))),
        "data_json": either,
        "dcat": V.list_of(F.try_variant_get(root, "$['@graph']", "variant")),
        "sparql": V.list_of(V.at(root, "results.bindings")),
        "socrata": V.list_of(V.at(root, "results")),
        "opendatasoft": V.list_of(V.at(root, "results")),
        "arcgis": V.list_of(V.at(root, "features")),
        "stac": V.list_of(V.at(root, "collections")),
    }


def records(pages: DataFrame, family: str) -> DataFrame:
    """portal_url, language, url_template, page, pos and node (a variant) of each record of a family's pages."""
    parsed = pages.select(*PAGE, V.parsed(F.col("body")).alias("root"))
    return parsed.select(*PAGE, F.posexplode(_lists(F.col("root"))[family]).alias("pos", "node"))


def bad_pages(pages: DataFrame, family: str) -> DataFrame:
    """Pages that are no JSON or lack the family's list; of STAC also those with a collection without an id."""
    root = V.parsed(F.col("body"))
    found = _lists(root)[family]
    bad = found.isNull()
    if family == "stac":
        bad = bad | F.coalesce(F.exists(found, lambda c: F.coalesce(F.trim(V.string_at(c, "id")), F.lit("")) == ""), F.lit(False))
    return pages.where(bad)


def declared_count(pages: DataFrame, family: str) -> DataFrame:
    """portal_url, page and the number of records that a page declares for the whole catalog."""
    path = {"ckan": "result.count", "socrata": "resultSetSize", "opendatasoft": "total_count"}[family]
    return pages.select("portal_url", "page", F.try_variant_get(V.parsed(F.col("body")), "$." + path, "bigint").alias("declared"))


def is_dataset_node(node: Column) -> Column:
    """Whether @type, a string or a list, names a dataset."""
    kind = F.try_variant_get(node, "$['@type']", "variant")
    names = F.coalesce(F.transform(V.list_of(kind), V.string_of), F.array(V.string_of(kind)))
    return F.coalesce(F.exists(names, lambda n: n.isin("dcat:Dataset", "Dataset", "http://www.w3.org/ns/dcat#Dataset")), F.lit(False))
