"""Noise filter, predicates of the catalog, and the flat rows of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import variants as V
from lodestar.operators import dedupe, resources

LEAST_TITLE_BYTES = 5
NOISE_WORDS = ["test", "prova", "esempio"]
#: Columns of a snapshot row, in their order.
SNAPSHOT = ["original_id", "source_portal", "portal_name", "url", "title", "description", "record_kind", "tags", "organization", "license", "metadata_created", "metadata_modified", "first_seen_at", "language", "is_duplicate", "resources"]


def is_noise(title: Column, description: Column, least_bytes: int = LEAST_TITLE_BYTES, noise: list[str] | None = None) -> Column:
    """a title of few UTF-8 bytes or with a noise word, or a blank description."""
    low = F.lower(title)
    out = (F.octet_length(title) < least_bytes) | X.non_blank(F.coalesce(description, F.lit(""))).isNull()
    for word in NOISE_WORDS if noise is None else noise:
        out = out | F.contains(low, F.lit(word))
    return F.coalesce(out, F.lit(True))


def is_searchable() -> Column:
    """embedded, not stale, a dataset or series."""
    return F.col("embedding").isNotNull() & ~F.col("is_stale") & F.col("record_kind").isin("dataset", "series")


def is_pending(*, any_kind: bool = False) -> Column:
    """not embedded, not stale, a dataset or series with some text; F4 counts any kind."""
    some = F.trim(F.concat(F.col("title"), F.lit(" "), F.coalesce("description", F.lit("")))) != ""
    out = F.col("embedding").isNull() & ~F.col("is_stale") & some
    return out if any_kind else out & F.col("record_kind").isin("dataset", "series")


def modified_since(modified: Column, mark: Column, policy: Column) -> Column:
    """whether a record counts as modified since the mark, by its family's policy.

    `inclusive` leaves undated records out, `inclusive_undated` and `strict_undated` keep
    them; families without support (`full`) take all.
    """
    return (
        F.when(policy == "inclusive", F.coalesce(modified >= mark, F.lit(False)))
        .when(policy == "inclusive_undated", modified.isNull() | (modified >= mark))
        .when(policy == "strict_undated", modified.isNull() | (modified > mark))
        .otherwise(F.lit(True))
    )


#: Policy of each family (fixed values).
POLICIES = {
    "ckan": "inclusive", "opendatasoft": "inclusive", "arcgis": "inclusive", "socrata": "inclusive",
    "data_json": "inclusive_undated", "sparql": "strict_undated", "dcat": "server",
    "stac": "full", "sdmx": "full", "ogc_records": "full",
}


def policy_of(family: Column) -> Column:
    out = F.lit("full")
    for name, policy in POLICIES.items():
        out = F.when(family == name, F.lit(policy)).otherwise(out)
    return out


def kind_of_scope(code: Column) -> Column:
    """record kind of an ISO scope code."""
    low = F.lower(X.trimmed(code))
    return (
        F.when(low.isNull() | (low == "") | (low == "dataset"), "dataset")
        .when(low.isin("series", "collection"), "series")
        .when(low == "service", "service")
        .when(low.isin("map", "model", "tile"), "map")
        .otherwise("other")
    )


def stored_kind(kind: Column) -> Column:
    """a stored kind, unknown ones as dataset."""
    return F.when(kind.isin("dataset", "series", "service", "map", "other"), kind).otherwise("dataset")


def with_portal_facts(canonical: DataFrame, portals: DataFrame) -> DataFrame:
    """portal_name, portal_language, portal_type and portal_profile of each row's canonical portal.

    Portals that aren't configured are named after their host; their language is the
    metadata's in lower case, else unknown, as is their type.
    """
    facts = portals.select(
        X.without_trailing_slashes(F.col("url")).alias("__url"), F.col("name").alias("__name"), F.col("language").alias("__language"), F.col("type").alias("__type"), F.col("profile").alias("portal_profile")
    )
    own = F.lower(V.string_at(V.parsed(F.col("metadata")), "language"))
    joined = canonical.join(dedupe.small(facts), F.col("canonical_portal") == F.col("__url"), "left")
    return joined.withColumns(
        {
            "portal_name": F.coalesce("__name", X.portal_name(F.col("canonical_portal"))),
            "portal_language": F.coalesce("__language", own, F.lit("unknown")),
            "portal_type": F.coalesce("__type", F.lit("unknown")),
        }
    ).drop("__url", "__name", "__language", "__type")


#: The order of a snapshot's rows: newest first; the rest tells rows of one moment apart.
NEWEST_FIRST = ["last_updated_at", "id", "source_portal", "original_id", "content_hash"]


def newest_first(rows: DataFrame) -> DataFrame:
    """The rows in ranges of NEWEST_FIRST (of its columns that are there), each range sorted."""
    order = [F.col(c).desc_nulls_last() if c == "last_updated_at" else F.col(c) for c in NEWEST_FIRST if c in rows.columns]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def snapshot_rows(catalog: DataFrame, portals: DataFrame, *, resource_lists: bool = True, ordered: bool = False) -> DataFrame:
    """The curated catalog: duplicates flagged over all rows, noise left out, one flat row each.

    Without resource_lists the column resources, a large expression, is neither planned nor there.
    ordered deals the rows newest first; they are dealt before the flat rows are derived, as the
    ranges' bounds take a pass of their own.

    The alias and portal dimensions are joined by broadcast if counted small; the one
    shuffle is that of the duplicate titles.
    """
    flagged = dedupe.with_duplicate_flag(dedupe.with_canonical_portal(catalog, portals))
    clean = flagged.where(~is_noise(F.col("title"), F.col("description")))
    facts = with_portal_facts(clean, portals)
    facts = (newest_first(facts) if ordered else facts).withColumn("__m", V.parsed(F.col("metadata")))
    m = F.col("__m")
    derived = [resources.summaries(resources.resources_of("__m")).alias("resources")] if resource_lists else []
    return facts.select(
        "original_id",
        F.col("canonical_portal").alias("source_portal"),
        "portal_name",
        "url",
        "title",
        F.coalesce("description", F.lit("")).alias("description"),
        stored_kind(F.col("record_kind")).alias("record_kind"),
        V.tags(m).alias("tags"),
        V.organization(m).alias("organization"),
        V.license_name(m).alias("license"),
        V.text_or_empty(m, "metadata_created").alias("metadata_created"),
        V.text_or_empty(m, "metadata_modified").alias("metadata_modified"),
        X.rfc3339(F.col("first_seen_at")).alias("first_seen_at"),
        F.col("portal_language").alias("language"),
        "is_duplicate",
        *derived,
        "portal_type",
        "portal_profile",
        "content_hash",
    )
