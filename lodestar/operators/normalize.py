"""Records of each portal family as rows of one catalog.

Every job returns original_id, source_portal, url, title, description, record_kind,
metadata (the raw record as JSON), modified and content_hash (of language, title and
description). Records without their required fields are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import variants as V
from lodestar.functions.html import html_to_text
from lodestar.operators.curate import kind_of_scope
from lodestar.operators.dedupe import keep_first

COLUMNS = ["original_id", "source_portal", "url", "title", "description", "record_kind", "metadata", "modified", "content_hash"]
#: Priority of SDMX annotations that hold an update time (fixed values).
UPDATE_ANNOTATIONS = ["UPDATE_DATA", "LAST_UPDATE", "UPDATE_STRUCTURE", "CREATED"]


def _catalog(rows: DataFrame, required: list[str], *, across_pages: bool = False) -> DataFrame:
    """Rows with the hash, without those that miss a required column; across_pages: of an id only the first of a run."""
    kept = rows.dropna(subset=required)
    if across_pages:
        kept = keep_first(kept, ["source_portal", "original_id"], [F.col("page"), F.col("pos")])
    hashed = X.content_hash(F.col("title"), F.col("description"), F.col("language"))
    return kept.withColumn("content_hash", hashed).select(*COLUMNS)


def _base(portal: Column) -> Column:
    return X.without_trailing_slashes(portal)


def _first_date(node: Column, paths: list[str]) -> Column:
    return F.coalesce(*[X.parsed_date(V.string_at(node, p)) for p in paths])


def _html(value: Column) -> Column:
    return F.nullif(html_to_text(value), F.lit(""))


def _no_date() -> Column:
    return F.lit(None).cast("timestamp")


def _select(records: DataFrame, **columns: Column) -> DataFrame:
    """The named columns, the portal as it is, the language, and a record's page and position where it has them."""
    place = [c for c in ("page", "pos") if c in records.columns]
    return records.select(F.col("portal_url").alias("source_portal"), "language", *place, *[c.alias(k) for k, c in columns.items()])


def ckan(records: DataFrame) -> DataFrame:
    """N1."""
    n, lang = F.col("node"), F.col("language")
    key, name = V.string_at(n, "id"), V.string_at(n, "name")
    notes = V.at(n, "notes")
    description = F.when(notes.isNull() | F.is_variant_null(notes), V.localized(V.at(n, "description"), lang)).otherwise(V.localized(notes, lang))
    plain = F.concat(_base(F.col("portal_url")), F.lit("/dataset/"), name)
    url = F.coalesce(X.filled_template(F.col("url_template"), {"id": key, "name": name}), plain)
    rest = F.map_filter(F.try_variant_get(n, "$", V.Entry), lambda k, _: ~k.isin("id", "name", "title", "notes"))
    rows = _select(
        records, original_id=key, url=url, title=F.when(V.present(n, "title"), V.localized(V.at(n, "title"), lang)), description=F.nullif(description, F.lit("")), record_kind=F.lit("dataset"),
        metadata=F.to_json(rest), modified=X.parsed_date(V.string_at(n, "metadata_modified")),
    )
    return _catalog(rows, ["original_id", "title", "url"])


def data_json(records: DataFrame) -> DataFrame:
    """N4."""
    n, lang = F.col("node"), F.col("language")
    key, title = V.dcat_us_text(V.at(n, "identifier"), lang), V.dcat_us_text(V.at(n, "title"), lang)
    page = V.dcat_us_text(F.coalesce(V.at(n, "landingPage"), V.at(n, "landing_page")), lang)
    some = lambda c: F.when(X.non_blank(c).isNotNull(), c)
    rows = _select(
        records, original_id=some(key), title=some(title), description=some(V.dcat_us_text(V.at(n, "description"), lang)),
        url=F.coalesce(F.when(X.is_url(page), page), F.when(X.is_url(key), key), F.col("portal_url")), record_kind=F.lit("dataset"),
        metadata=F.to_json(n), modified=X.parsed_date(V.dcat_us_text(V.at(n, "modified"), lang)),
    )
    return _catalog(rows, ["original_id", "title"])


def socrata(records: DataFrame) -> DataFrame:
    """N5."""
    n, resource = F.col("node"), V.at(F.col("node"), "resource")
    key = X.non_blank(V.string_at(resource, "id"))
    own = F.split_part(F.regexp_replace("portal_url", "^https?://", ""), F.lit("/"), F.lit(1))
    domain = F.coalesce(F.when(X.non_blank(V.string_at(n, "metadata.domain")).isNotNull(), V.string_at(n, "metadata.domain")), own)
    valid = lambda p: F.when(X.is_url(V.string_at(n, p)), V.string_at(n, p))
    rows = _select(
        records, original_id=key, title=X.non_blank(V.string_at(resource, "name")), description=_html(V.string_at(resource, "description")),
        url=F.coalesce(valid("link"), valid("permalink"), F.concat(X.url_scheme(F.col("portal_url")), F.lit("://"), domain, F.lit("/d/"), key)), record_kind=F.lit("dataset"),
        metadata=F.to_json(n), modified=_first_date(resource, ["updatedAt", "metadata_updated_at", "data_updated_at"]),
    )
    return _catalog(rows, ["original_id", "title"], across_pages=True)


def socrata_facets(records: DataFrame) -> DataFrame:
    """Id, category, tags, license and publisher of Socrata records."""
    n = F.col("node")
    c = V.at(n, "classification")
    tags = F.concat(V.text_list(V.at(c, "domain_tags")), V.text_list(V.at(c, "tags")))
    first = lambda p: F.try_element_at(V.text_list(V.at(n, p)), F.lit(1))
    return records.select(
        V.string_at(n, "resource.id").alias("original_id"),
        F.coalesce(F.when(X.non_blank(V.string_at(c, "domain_category")).isNotNull(), V.string_at(c, "domain_category")), F.try_element_at(V.text_list(V.at(c, "categories")), F.lit(1))).alias("category"),
        V.deduplicated(tags).alias("tags"),
        first("resource.license").alias("license"),
        F.coalesce(first("resource.attribution"), first("owner.display_name"), first("creator.display_name")).alias("publisher"),
    )


def opendatasoft(records: DataFrame) -> DataFrame:
    """N6."""
    n, metas = F.col("node"), V.at(F.col("node"), "metas.default")
    key = X.non_blank(V.string_at(n, "dataset_id"))
    rows = _select(
        records, original_id=key, title=F.coalesce(X.non_blank(V.string_at(metas, "title")), key), description=_html(V.string_at(metas, "description")),
        url=F.concat(_base(F.col("portal_url")), F.lit("/explore/dataset/"), key, F.lit("/")), record_kind=F.lit("dataset"),
        metadata=F.to_json(n), modified=X.parsed_date(V.string_at(metas, "modified")),
    )
    return _catalog(rows, ["original_id"], across_pages=True)


def opendatasoft_facets(records: DataFrame) -> DataFrame:
    """Id, themes, keywords (both without repeats) and publisher."""
    n, metas = F.col("node"), V.at(F.col("node"), "metas.default")
    first = lambda v, p: F.try_element_at(V.text_list(V.at(v, p)), F.lit(1))
    return records.select(
        V.string_at(n, "dataset_id").alias("original_id"),
        V.deduplicated(V.text_list(V.at(metas, "theme"))).alias("themes"),
        V.deduplicated(V.text_list(V.at(metas, "keyword"))).alias("keywords"),
        F.coalesce(first(metas, "publisher"), first(n, "metas.dcat.creator"), first(n, "metas.dcat.publisher")).alias("publisher"),
    )


def arcgis(records: DataFrame) -> DataFrame:
    """N7."""
    n, p = F.col("node"), V.at(F.col("node"), "properties")
    key = F.coalesce(X.non_blank(V.string_at(n, "id")), X.non_blank(V.string_at(p, "id")))
    rows = _select(
        records, original_id=key, title=F.coalesce(X.non_blank(V.string_at(p, "title")), key),
        description=F.coalesce(_html(V.string_at(p, "description")), X.non_blank(V.string_at(p, "snippet"))),
        url=F.concat(_base(F.col("portal_url")), F.lit("/datasets/"), key), record_kind=F.lit("dataset"),
        metadata=F.to_json(n), modified=X.from_millis(F.try_variant_get(p, "$.modified", "bigint")),
    )
    return _catalog(rows, ["original_id"], across_pages=True)


def arcgis_facets(records: DataFrame) -> DataFrame:
    """Id, categories without their prefix, tags, license and publisher."""
    n, p = F.col("node"), V.at(F.col("node"), "properties")
    text = lambda k: X.non_blank(V.string_at(p, k))
    return records.select(
        F.coalesce(X.non_blank(V.string_at(n, "id")), text("id")).alias("original_id"),
        V.deduplicated(V.without_categories(V.text_list(V.at(p, "categories")))).alias("categories"),
        V.deduplicated(V.text_list(V.at(p, "tags"))).alias("tags"),
        F.coalesce(text("license"), _html(V.string_at(p, "licenseInfo"))).alias("license"),
        F.coalesce(text("source"), text("accessInformation"), text("owner")).alias("publisher"),
    )


def _link(node: Column, rel: str) -> Column:
    links = F.filter(V.list_of(V.at(node, "links")), lambda k: V.string_at(k, "rel") == rel)
    return V.string_at(F.try_element_at(links, F.lit(1)), "href")


def resolved(base: Column, href: Column) -> Column:
    """An absolute http(s) link as it is; others below the base's host or, if relative, below the base."""
    host = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    relative = F.concat(_base(base), F.lit("/"), F.regexp_replace(href, r"^\./", ""))
    up = F.concat(F.regexp_replace(_base(base), r"/[^/]*$", ""), F.lit("/"), F.regexp_replace(href, r"^\.\./", ""))
    return (
        F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(host, href)).when(F.startswith(href, F.lit("../")), up).otherwise(relative)
    )


def stac(records: DataFrame) -> DataFrame:
    """N8."""
    n = F.col("node")
    some = lambda k: F.when(X.non_blank(V.string_at(n, k)).isNotNull(), V.string_at(n, k))
    href = F.coalesce(*[_link(n, rel) for rel in ("about", "canonical", "self")])
    rows = _select(
        records, original_id=some("id"), title=F.coalesce(some("title"), some("id")), description=some("description"),
        url=F.coalesce(resolved(F.col("portal_url"), href), F.col("portal_url")), record_kind=F.lit("series"),
        metadata=F.to_json(n), modified=X.parsed_date(F.coalesce(V.string_at(n, "updated"), V.string_at(n, "created"))),
    )
    return _catalog(rows, ["original_id"])


def with_distributions(graph: DataFrame) -> DataFrame:
    """Dataset nodes of JSON-LD pages with distributions, the JSON of what their references resolve to.

    A reference is a string or {"@id"}; it resolves to the last node of its page with that
    @id and stays as it is if there is none. Datasets without distributions have null.
    """
    from lodestar.sources.payloads import is_dataset_node

    page = ["portal_url", "page"]
    keys = ["dcat:distribution", "distribution"]
    field = F.coalesce(*[F.try_variant_get("node", f"$['{k}']", "variant") for k in keys])
    listed = F.when(is_dataset_node(F.col("node")), F.coalesce(V.list_of(field), F.when(field.isNotNull(), F.array(field))))
    one = lambda iri, value, at: F.struct(iri.alias("iri"), F.to_json(value).alias("json"), at.cast("int").alias("at"))
    iri_of = lambda v: F.try_variant_get(v, "$['@id']", "string")
    references = F.transform(listed, lambda r, i: one(F.coalesce(V.string_of(r), iri_of(r)), r, i))
    # nodes (without at) and references to them meet by IRI in one pass over the pages
    own = F.array(one(iri_of(F.col("node")), F.col("node"), F.lit(None)))
    each = graph.select(*page, "pos", F.inline(F.concat(own, F.coalesce(references, F.slice(own, 1, 0))))).where("iri is not null or at is not null")
    node = F.col("at").isNull()
    resolved = F.max_by(F.when(node, F.col("json")), F.when(node, F.col("pos"))).over(Window.partitionBy(*page, "iri"))
    found = each.withColumn("resolved", F.when(F.col("iri").isNotNull(), resolved)).where("at is not null").withColumnRenamed("json", "own")
    datasets = graph.where(is_dataset_node(F.col("node")))
    lists = found.groupBy(*page, "pos").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("resolved", "own").alias("json")))).alias("all"))
    lists = lists.select(*page, "pos", F.transform("all", lambda x: x["json"]).alias("distributions"))
    return datasets.join(lists, [*page, "pos"], "left")


def dcat(graph: DataFrame) -> DataFrame:
    """Datasets of JSON-LD pages, their distributions inlined."""
    n, lang = F.col("node"), F.col("language")
    iri = F.try_variant_get(n, "$['@id']", "string")
    text = lambda keys: F.coalesce(*[F.nullif(V.jsonld_text(F.try_variant_get(n, f"$['{k}']", "variant"), lang), F.lit("")) for k in keys])
    key = lambda k: F.try_variant_get(n, f"$['{k}']", "variant")
    named = F.coalesce(*[F.coalesce(F.nullif(V.string_of(key(k)), F.lit("")), F.nullif(V.string_at(key(k), "@value"), F.lit(""))) for k in ("identifier", "dct:identifier", "dcat:identifier")])
    inlined = F.concat(F.lit("["), F.array_join("distributions", ","), F.lit("]"))
    plain = F.to_json(n)
    metadata = F.when(F.col("distributions").isNull(), plain).otherwise(F.concat(F.regexp_replace(plain, r"\}$", ""), F.lit(',"distributions":'), inlined, F.lit("}")))
    rows = _select(
        with_distributions(graph), original_id=F.coalesce(named, X.last_segment(iri)), url=F.nullif(iri, F.lit("")), title=text(["title", "dct:title"]), description=text(["description", "dct:description"]),
        record_kind=F.lit("dataset"), metadata=metadata, modified=X.parsed_date(text(["modified", "dct:modified"])),
    )
    return _catalog(rows, ["url", "title", "original_id"])


def term(node: Column, key: str) -> Column:
    """A SPARQL binding's term: value, type, lang and datatype."""
    t = V.at(node, key)
    lang, datatype = F.try_variant_get(t, "$['xml:lang']", "string"), V.string_at(t, "datatype")
    return F.when(t.isNotNull(), F.struct(V.string_at(t, "value").alias("value"), V.string_at(t, "type").alias("type"), lang.alias("lang"), datatype.alias("datatype")))


def binding_json(node: Column) -> Column:
    """Q4: a binding as JSON: its variables in order, each a term with its value, type, language and datatype where it has them."""
    terms = V.entries_of(node)
    one = lambda e: F.struct(*[V.string_at(e["value"], k).alias(k) for k in ("type", "value", "datatype")], F.try_variant_get(e["value"], "$['xml:lang']", "string").alias("lang"))
    parts = F.transform(terms, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), V.term_json(one(e))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


#: Languages that stand in for each other (fixed values).
SIBLINGS = ["nb", "nn", "no"]


def language_rank(lang: Column, preferred: Column) -> Column:
    """3 for the preferred language's tag, 2 for a sibling of it, 1 for English, else 0."""
    return F.when(lang == preferred, 3).when(lang.isin(SIBLINGS) & preferred.isin(SIBLINGS), 2).when(lang == "en", 1).otherwise(0)


def sparql(bindings: DataFrame) -> DataFrame:
    """One row for each dataset URI of language-tagged bindings.

    The best title and description are chosen independently among the texts that aren't
    empty, by language rank (equal ranks: the last binding's); the identifier is the first
    non-empty one, else the URI's last segment; of URIs with one identifier the first
    stays, datasets without title go. metadata is the first binding with the chosen title,
    its terms without their null parts (Q4).
    """
    n, lang = F.col("node"), F.col("language")
    flat = bindings.select(
        "portal_url", "language", "page", "pos", term(n, "dataset")["value"].alias("uri"), term(n, "title").alias("t"), term(n, "description").alias("d"),
        F.nullif(term(n, "identifier")["value"], F.lit("")).alias("i"), term(n, "modified")["value"].alias("m"), binding_json(n).alias("json"),
    ).where("uri is not null")
    order = lambda c: F.struct(language_rank(F.col(c)["lang"], lang), "page", "pos")
    best = lambda c: F.when(F.col(c)["value"] != "", F.struct(order(c).alias("rank"), F.col(c)["value"].alias("value")))
    place = F.struct("page", "pos")
    # the first binding of each title; which title is chosen is known only after the second grouping
    texts = flat.groupBy("portal_url", "language", "uri", F.col("t.value").alias("title")).agg(
        F.min_by("json", place).alias("json"), F.max(F.when(F.col("t.value") != "", order("t"))).alias("rank"), F.max(best("d")).alias("d"),
        F.min(F.when(F.col("i").isNotNull(), F.struct(place.alias("place"), "i"))).alias("i"), F.max("m").alias("m"), F.min(place).alias("place"),
    )
    grouped = texts.groupBy("portal_url", "language", "uri").agg(
        F.max(F.when(F.col("rank").isNotNull(), F.struct("rank", "title", "json"))).alias("t"), F.max("d").alias("d"), F.min("i").alias("i"), F.max("m").alias("m"), F.min("place").alias("place"),
    )
    grouped = grouped.select("portal_url", "language", "uri", "t.title", "t.json", F.col("d.value").alias("description"), "i.i", "m", "place")
    named = grouped.withColumn("original_id", F.coalesce("i", X.last_segment(F.col("uri"))))
    first = keep_first(named.where("title is not null and title <> ''"), ["portal_url", "original_id"], [F.col("place"), F.col("uri")])
    rows = _select(first, original_id=F.col("original_id"), url=F.col("uri"), title=F.col("title"), description=F.nullif(F.col("description"), F.lit("")), record_kind=F.lit("dataset"), metadata=F.col("json"), modified=X.parsed_date(F.col("m")))
    return _catalog(rows, ["original_id"])


#: Property IRI, binding and JSON-LD key, and whether it refers to a node (fixed values).
PROPERTIES = [
    ("http://purl.org/dc/terms/title", "title", "dct:title", False),
    ("http://purl.org/dc/terms/description", "description", "dct:description", False),
    ("http://purl.org/dc/terms/format", "format", "dct:format", True),
    ("http://www.w3.org/ns/dcat#mediaType", "mediaType", "dcat:mediaType", True),
    ("http://www.w3.org/ns/dcat#downloadURL", "downloadURL", "dcat:downloadURL", True),
    ("http://www.w3.org/ns/dcat#accessURL", "accessURL", "dcat:accessURL", True),
]


def distributions(bindings: DataFrame) -> DataFrame:
    """One JSON-LD node for each dataset and distribution of (dataset, distribution, property, value) bindings.

    The values of a property are without repeats and ordered by language rank, tagged ones
    first; one stays alone, several become a list. @id is given only for safe IRIs.
    """
    known = bindings.sparkSession.createDataFrame(PROPERTIES, "iri string, binding string, key string, reference boolean")
    n = F.col("node")
    flat = bindings.select("portal_url", "language", term(n, "dataset")["value"].alias("uri"), term(n, "distribution")["value"].alias("node_iri"), term(n, "property")["value"].alias("iri"), term(n, "value").alias("v"))
    met = flat.where("uri is not null and v is not null").join(F.broadcast(known), "iri")
    rank = language_rank(F.col("v.lang"), F.col("language"))
    entry = F.struct((-rank).alias("rank"), F.col("v.lang").isNull().alias("plain"), F.coalesce("v.lang", F.lit("")).alias("lang"), F.col("v.value").alias("value"), F.col("v.type").alias("type"), F.coalesce("v.datatype", F.lit("")).alias("datatype"), V.term_jsonld(F.col("v")).alias("json"))
    per_key = met.groupBy("portal_url", "uri", "node_iri", "key").agg(F.array_sort(F.collect_set(entry)).alias("all"))
    field = F.concat(F.lit('"'), "key", F.lit('":'), V.collapsed(F.transform("all", lambda e: e["json"])))
    nodes = per_key.select("portal_url", "uri", "node_iri", F.struct("key", field.alias("json")).alias("field")).groupBy("portal_url", "uri", "node_iri").agg(F.array_sort(F.collect_list("field")).alias("fields"))
    own = F.when(X.is_safe_iri(F.col("node_iri")), F.concat(F.lit('"@id":'), F.to_json(F.array("node_iri")).substr(F.lit(2), F.length(F.to_json(F.array("node_iri"))) - 2), F.lit(",")))
    return nodes.select("portal_url", "uri", "node_iri", F.concat(F.lit("{"), F.coalesce(own, F.lit("")), F.array_join(F.transform("fields", lambda f: f["json"]), ","), F.lit("}")).alias("json"))


def attach_distributions(catalog: DataFrame, nodes: DataFrame) -> DataFrame:
    """Catalog rows with their distributions in the metadata; grouped first, so that no row is multiplied."""
    lists = nodes.groupBy(F.col("portal_url").alias("source_portal"), F.col("uri").alias("url")).agg(F.array_sort(F.collect_list("json")).alias("all"))
    joined = catalog.join(lists, ["source_portal", "url"], "left")
    more = F.concat(F.regexp_replace("metadata", r"\}$", ""), F.lit(',"dcat:distribution":['), F.array_join("all", ","), F.lit("]}"))
    return joined.withColumn("metadata", F.coalesce(more, F.col("metadata"))).drop("all")


def publishers(bindings: DataFrame) -> DataFrame:
    """Distinct publishers of the bindings, ascending."""
    return bindings.select(term(F.col("node"), "publisher")["value"].alias("publisher")).where("publisher is not null").distinct().orderBy("publisher")


def dataset_count(bindings: DataFrame) -> DataFrame:
    """Number of distinct datasets of the bindings."""
    return bindings.agg(F.countDistinct(term(F.col("node"), "dataset")["value"]).alias("datasets"))


def sdmx(flows: DataFrame) -> DataFrame:
    """SDMX dataflows. modified is that of the annotation of the best priority whose title parses.

    A url template's {id}, {agency}, {version} and {flow_ref} are filled in (X9); without one
    the landing page is the structure's URL. metadata holds the dataflow's names, texts and
    references as published.
    """
    f = flows.where("error is null and flow_id is not null").withColumn("agency", F.coalesce("agency", F.lit("all"))).withColumn("version", F.coalesce("version", F.lit("latest")))
    ranks = F.array(*map(F.lit, UPDATE_ANNOTATIONS))
    dated = F.transform("annotations", lambda a: F.struct(F.array_position(ranks, F.upper(a["type"])).alias("rank"), X.parsed_date(F.trim(a["title"]), bare_offset=True).alias("date")))
    best = F.array_min(F.filter(dated, lambda d: (d["rank"] > 0) & d["date"].isNotNull()))["date"]
    base = _base(F.col("portal_url"))
    f = f.withColumns({"flow_ref": F.concat_ws(",", "agency", "flow_id", "version"), "modified": best})
    f = f.withColumn("structure_url", F.coalesce("structure_url", F.concat_ws("/", base, F.lit("dataflow"), "agency", "flow_id", "version")))
    own = F.struct(
        F.col("agency").alias("agency_id"), F.col("flow_id").alias("dataflow_id"), "version", "flow_ref", "urn", "is_final", "structure_url",
        F.concat(base, F.lit("/data/"), "flow_ref").alias("data_url"), F.col("structure").alias("data_structure"),
    )
    head = (F.lit("series").alias("catalog_record_kind"), F.lit("application/vnd.sdmx.structure+xml").alias("source_format"))
    metadata = F.to_json(F.struct(*head, own.alias("sdmx"), "names", "descriptions", "annotations", X.rfc3339(F.col("modified")).alias("modified")), {"ignoreNullFields": "false"})
    template = F.col("url_template") if "url_template" in flows.columns else F.lit(None).cast("string")
    filled = X.filled_template(template, {"id": F.col("flow_id"), "agency": F.col("agency"), "version": F.col("version"), "flow_ref": F.col("flow_ref")})
    rows = _select(
        f, original_id=F.concat_ws(":", "agency", "flow_id"), url=F.coalesce(filled, "structure_url"), title=F.coalesce(V.language_text(F.col("names"), F.col("language")), "flow_id"),
        description=V.language_text(F.col("descriptions"), F.col("language")), record_kind=F.lit("series"), metadata=metadata, modified=F.col("modified"),
    )
    return _catalog(rows, ["original_id"])


def csw(records: DataFrame) -> DataFrame:
    """CSW records; the landing page is the first link that is no download, else any, else the portal."""
    r = records.where("error is null and identifier is not null")
    page = F.try_element_at(F.filter("links", lambda k: ~k["downloadable"]), F.lit(1))["url"]
    metadata = F.to_json(F.struct(F.transform("links", lambda k: F.struct(k["url"].alias("url"), k["name"].alias("name"), k["protocol"].alias("protocol"))).alias("online_resources"), "keywords", "bbox", "organization"))
    rows = _select(
        r, original_id=F.col("identifier"), url=F.coalesce(page, F.try_element_at("links", F.lit(1))["url"], F.col("portal_url")), title=F.coalesce("title", "identifier"), description=F.col("description"),
        record_kind=kind_of_scope(F.col("scope")), metadata=metadata, modified=X.parsed_date(F.col("modified"), bare_offset=True),
    )
    return _catalog(rows, ["original_id"])


def count_mismatches(counts: DataFrame) -> DataFrame:
    """Each page whose declared number of records isn't the parsed one, also if it holds none (of csw_counts())."""
    return counts.where("declared <> parsed").select("portal_url", "page", "declared", "parsed")


#: The job of each family over its records.
FAMILIES = {"ckan": ckan, "dcat": dcat, "sparql": sparql, "data_json": data_json, "socrata": socrata, "opendatasoft": opendatasoft, "arcgis": arcgis, "stac": stac, "sdmx": sdmx, "ogc_records": csw}


def union(families: dict[str, DataFrame]) -> DataFrame:
    """One catalog from the records of several families."""
    out = None
    for name, records in families.items():
        rows = FAMILIES[name](records)
        out = rows if out is None else out.unionByName(rows)
    return out
