"""Resources derived from a dataset's metadata: one list whatever shape a portal publishes them in.

The derivation is one large expression. It is written as SQL text, which the session parses
at once; the same expression made of column objects took ten times as long to build.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import variants as V
from lodestar.functions.text import SERVICES, VISIBLE, WHITE

FIELD = "struct<name:string,type:string,description:string>"
RESOURCE = f"struct<name:string,format:string,media_type:string,url:string,description:string,fields:array<{FIELD}>>"
#: Keys under which lists of resources stand, in the order of the result (fixed values).
LISTS = ["resources", "distribution", "dcat:distribution", "distributions", "online_resources", "attachments", "alternative_exports"]
#: Keys that a resource node, a column description and the metadata are read by (fixed values).
NODE_KEYS = [
    "name", "title", "dct:title", "protocol", "format", "dct:format", "mimetype", "mediaType", "mediatype", "media_type", "dcat:mediaType",
    "url", "downloadURL", "accessURL", "dcat:downloadURL", "dcat:accessURL", "description", "dct:description",
]
FIELD_KEYS = ["name", "id", "type", "datastore_type", "description", "title", "label"]
SHAPE_KEYS = ["dataset_id", "metas", "resource", "metadata", "link", "permalink", "properties", "stac_version", "assets", "sdmx"]
COLUMN_KEYS = ["columns_field_name", "columns_name", "columns_datatype", "columns_description"]


def _struct(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"`{k}`:{kind}" for k, kind in fields.items()) + ">"


#: What the metadata is read as, in one pass; parts of another shape are null, those of changing shape stay variants.
FIELD_NODE = _struct(dict.fromkeys(FIELD_KEYS, "variant"))
_TAIL = {"schema": _struct({"fields": f"array<{FIELD_NODE}>"}), "fields": f"array<{FIELD_NODE}>"}
NODE = _struct(dict.fromkeys(NODE_KEYS, "variant") | _TAIL)
METADATA = _struct(dict.fromkeys(SHAPE_KEYS, "variant") | {"fields": f"array<{FIELD_NODE}>"} | dict.fromkeys(LISTS, f"array<{NODE}>"))
#: A node's fields by number: some names differ in case only, which a struct's names can't.
NUMBERED = _struct({f"k{i}": "variant" for i in range(len(NODE_KEYS))} | _TAIL)
#: The same, texts being read as strings, for metadata that holds lists of resources alone.
PLAIN_FIELD = _struct(dict.fromkeys(FIELD_KEYS, "string"))
_PLAIN_TAIL = {"schema": _struct({"fields": f"array<{PLAIN_FIELD}>"}), "fields": f"array<{PLAIN_FIELD}>"}
PLAIN_NODE = _struct(dict.fromkeys(NODE_KEYS, "string") | _PLAIN_TAIL)
PLAIN_NUMBERED = _struct({f"k{i}": "string" for i in range(len(NODE_KEYS))} | _PLAIN_TAIL)
TABLE_KEYS = ["metas", "resource", "stac_version", "properties", "sdmx"]
PLAIN = _struct(dict.fromkeys(TABLE_KEYS, "variant") | dict.fromkeys(LISTS, f"array<{PLAIN_NODE}>"))
#: What the text of a value that is no string begins with, in any line: a number, an object, a list or a truth value as a whole.
NO_STRING = r"(?m)^(-?[0-9][0-9.]*([eE][-+]?[0-9]+)?$|[{\[]|true$|false$)"
NO_FIELDS = f"cast(array() AS array<{FIELD}>)"
NO_RESOURCES = f"cast(array() AS array<{RESOURCE}>)"


# The functions below take and return SQL text.


def _let(value: str, name: str, use: str) -> str:
    """use, in which the name stands for the value, computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _get(value: str, kind: str, path: str = "$") -> str:
    return f"try_variant_get({value}, '{path}', '{kind}')"


def _non_blank(text: str) -> str:
    return f"CASE WHEN {text} RLIKE r'{VISIBLE}' THEN {text} ELSE nullif(btrim({text}, '{WHITE}'), '') END"


def _string(value: str) -> str:
    """The text of a variant that is a string, null for any other."""
    return f"CASE WHEN substring(to_json({value}), 1, 1) = '\"' THEN {_get(value, 'string')} END"


def _texts(struct: str, name: str, groups: list[tuple[bool, list[str]]], use: str) -> str:
    """use, in which name[i] is the first usable text of group i of a struct's variants.

    Usable is a non-blank string, that of an object's @value (before it the @id if the group's
    flag allows references), or that of a list's first element that has one. What is read
    as a string tells most strings at once; only what might be another shape is looked at
    closer. The rule stands once for all groups.
    """
    plain = lambda v: _non_blank(_get(v, "string"))
    of_object = lambda v: "coalesce(" + f"CASE WHEN g.refs THEN {_non_blank(_string(_get(v, 'variant', '$.@id')))} END, " + _non_blank(_string(_get(v, "variant", "$.@value"))) + ")"
    element = f"CASE WHEN substring(to_json(e), 1, 1) = '\"' THEN {plain('e')} ELSE {of_object('e')} END"
    of_list = f"try_element_at(filter(transform({_get('p.v', 'array<variant>')}, e -> {element}), t -> t IS NOT NULL), 1)"
    closer = f"""CASE substring(to_json(p.v), 1, 1) WHEN '"' THEN {plain('p.v')} WHEN '{{' THEN {of_object('p.v')} WHEN '[' THEN {of_list} END"""
    read = f"transform(filter(g.vs, v -> v IS NOT NULL), v -> struct(v AS v, {_get('v', 'string')} AS t))"
    rule = f"try_element_at(filter(transform({read}, p -> CASE WHEN p.t RLIKE r'{V.UNSURE}' THEN {closer} ELSE {_non_blank('p.t')} END), t -> t IS NOT NULL), 1)"
    values = ", ".join(f"struct({str(refs).lower()} AS refs, array({', '.join(f'{struct}`{k}`' for k in keys)}) AS vs)" for refs, keys in groups)
    return _let(f"transform(array({values}), g -> {rule})", name, use)


def _resource(name: str = "NULL", form: str = "NULL", media: str = "NULL", url: str = "NULL", description: str = "NULL", fields: str = NO_FIELDS) -> str:
    texts = ", ".join(f"cast({x} AS string)" for x in (name, form, media, url, description))
    return f"cast(struct({texts}, {fields}) AS {RESOURCE})"


def _kept(resources: str) -> str:
    """Those with any of name, format, media type, url or fields; a description alone is nothing."""
    return f"coalesce(filter({resources}, r -> coalesce(r.name, r.format, r.media_type, r.url) IS NOT NULL OR size(r.fields) > 0), {NO_RESOURCES})"


def _one(condition: str, resource: str) -> str:
    """A list of the resource if the condition holds and it is informative, else an empty one."""
    return f"CASE WHEN {condition} THEN {_kept(f'array({resource})')} ELSE {NO_RESOURCES} END"


def _field_list(nodes: str) -> str:
    """Column descriptions with a name from a list of nodes (FIELD_NODE)."""
    one = _texts("c.", "d", [(False, ["name", "id"]), (False, ["type", "datastore_type"]), (False, ["description", "title", "label"])], f"cast(struct(d[0], d[1], d[2]) AS {FIELD})")
    return f"coalesce(filter(transform({nodes}, c -> {one}), f -> f.name IS NOT NULL), {NO_FIELDS})"


def _plain_field_list(nodes: str) -> str:
    """R7 where all texts are strings (PLAIN_FIELD)."""
    first = lambda *keys: "coalesce(" + ", ".join(_non_blank(f"c.`{k}`") for k in keys) + ")"
    one = f"cast(struct({first('name', 'id')}, {first('type', 'datastore_type')}, {first('description', 'title', 'label')}) AS {FIELD})"
    return f"coalesce(filter(transform({nodes}, c -> {one}), f -> f.name IS NOT NULL), {NO_FIELDS})"


def _plain_texts(struct: str, name: str, groups: list[tuple[bool, list[str]]], use: str) -> str:
    """_texts() where all texts are strings: use, in which name[i] is the first one of group i that isn't blank."""
    values = ", ".join("coalesce(" + ", ".join([_non_blank(f"{struct}`{k}`") for k in keys] + ["NULL"]) + ")" for _, keys in groups)
    return _let(f"array({values})", name, use)


def _all_strings(node: str) -> str:
    """Whether all texts of a node (PLAIN_NUMBERED) and of its fields are strings; a text that only looks otherwise is none."""
    looks = lambda struct, keys: f"concat_ws('\n', {', '.join(f'{struct}.`{k}`' for k in keys)}) RLIKE r'{NO_STRING}'"
    own = looks(node, [f"k{i}" for i in range(len(NODE_KEYS))])
    return f"NOT ({own} OR coalesce(exists(coalesce({node}.schema.fields, {node}.fields), c -> {looks('c', FIELD_KEYS)}), false))"


def _node(texts: Callable[..., str] = _texts, field_list: Callable[[str], str] = _field_list) -> str:
    """One resource or distribution node n (NUMBERED)."""
    number = lambda refs, *keys: (refs, [f"k{NODE_KEYS.index(k)}" for k in keys])
    groups = [
        number(False, "name", "title", "dct:title"), number(True, "format", "dct:format"), number(True, "mimetype", "mediaType", "mediatype", "media_type", "dcat:mediaType"),
        number(True, "url", "downloadURL", "accessURL", "dcat:downloadURL", "dcat:accessURL"), number(False, "description", "dct:description"), number(False, "protocol"),
    ]
    mime = "contains(x[5], '/') AND NOT contains(x[5], '://')"
    services = " ".join(f"WHEN contains(lower(x[5]), '{code}') OR contains(lower(x[5]), '{spelled}') THEN '{code.upper()}'" for code, spelled in SERVICES)
    made = _resource(
        "x[0]",
        f"coalesce(CASE WHEN contains(x[1], '://') THEN element_at(split(regexp_replace(x[1], '/+$', ''), '/'), -1) ELSE x[1] END, CASE WHEN {mime} THEN NULL {services} END)",
        f"coalesce(x[2], CASE WHEN {mime} THEN btrim(split_part(x[5], ';', 1), '{WHITE}') END)",
        "x[3]", "x[4]", field_list("coalesce(n.schema.fields, n.fields)"),
    )
    return texts("n.", "x", groups, made)


def _opendatasoft_table() -> str:
    """R2: the table that an OpenDataSoft dataset is; metas must be an object."""
    title = _let(f"struct({_get('m.metas', 'variant', '$.default.title')} AS title)", "s", _texts("s.", "x", [(False, ["title"])], "x[0]"))
    table = _resource(f"coalesce({title}, {_string('m.dataset_id')})", fields=_field_list("m.fields"))
    made = _one(f"{_string('m.dataset_id')} IS NOT NULL AND substring(to_json(m.metas), 1, 1) = '{{'", table)
    return f"filter({made}, r -> size(r.fields) > 0)"


def _socrata_table() -> str:
    """The table of a Socrata entry; a link only for four-by-four ids."""
    kind = _struct(dict.fromkeys(("id", "name"), "variant") | dict.fromkeys(COLUMN_KEYS, "array<variant>"))
    texts = ", ".join(f"{_non_blank(_string(f'get(s.`{k}`, i)'))} AS {x}" for k, x in zip(COLUMN_KEYS, ("name", "label", "type", "about"), strict=True))
    named = "coalesce(p.name, p.label)"
    described = f"cast(struct({named}, p.type, coalesce(p.about, CASE WHEN p.label <> {named} THEN p.label END)) AS {FIELD})"
    most = "greatest(" + ", ".join(f"size(coalesce(s.`{k}`, array()))" for k in COLUMN_KEYS) + ")"
    rows = _let(most, "c", f"transform(filter(sequence(0, c), i -> i < c), i -> struct({texts}))")
    fields = f"filter(transform({rows}, p -> {described}), f -> f.name IS NOT NULL)"
    links = f"struct({_string('m.link')} AS link, {_string('m.permalink')} AS permalink, {_non_blank(_string(_get('m.metadata', 'variant', '$.domain')))} AS domain)"
    link = "coalesce(CASE WHEN contains(l.link, '://') THEN l.link END, l.permalink, '')"
    url = f"CASE WHEN x[0] RLIKE '^[a-z0-9]{{4}}-[a-z0-9]{{4}}$' THEN concat(CASE WHEN startswith({link}, 'http://') THEN 'http' ELSE 'https' END, '://', l.domain, '/resource/', x[0], '.json') END"
    table = _resource("x[1]", "CASE WHEN u IS NOT NULL THEN 'JSON' END", "CASE WHEN u IS NOT NULL THEN 'application/json' END", "u", fields=fields)
    made = _texts("s.", "x", [(False, ["id"]), (False, ["name"])], _let(url, "u", table))
    return _let(_get("m.resource", kind), "s", _let(links, "l", _one("s IS NOT NULL AND l.domain IS NOT NULL", made)))


def _arcgis_service() -> str:
    """The service behind an ArcGIS item, if it has a url; a key counts as there if it is null."""
    service = _texts("s.", "x", [(False, ["name"]), (False, ["type"]), (False, ["url"])], _resource("x[0]", "x[1]", url="x[2]"))
    there = f"exists(map_keys({_get('m.properties', V.Entry)}), k -> k IN ('orgId', 'typeKeywords'))"
    return _let(_get("m.properties", _struct(dict.fromkeys(("name", "type", "url"), "variant"))), "s", f"filter({_one(there, service)}, r -> r.url IS NOT NULL)")


def _stac_assets() -> str:
    """The assets of a STAC collection, by key."""
    entries = _get("m.assets", f"map<string,{_struct(dict.fromkeys(('title', 'type', 'href', 'description'), 'variant'))}>")
    asset = _texts("a.", "x", [(False, [k]) for k in ("title", "type", "href", "description")], _resource("coalesce(x[0], nullif(k, ''))", media="x[1]", url="x[2]", description="x[3]"))
    made = f"transform(filter(array_sort(map_keys(b)), k -> b[k] IS NOT NULL), k -> {_let('b[k]', 'a', asset)})"
    return f"CASE WHEN {_string('m.stac_version')} IS NOT NULL THEN {_let(entries, 'b', _kept(made))} ELSE {NO_RESOURCES} END"


def _sdmx_endpoint() -> str:
    """The data endpoint of an SDMX dataflow."""
    kind = _struct(dict.fromkeys(("flow_ref", "data_url", "agency_id", "dataflow_id"), "variant"))
    endpoint = _texts("s.", "x", [(False, ["flow_ref"]), (False, ["data_url"])], _resource("x[0]", "'SDMX-CSV'", "'application/vnd.sdmx.data+csv'", "x[1]"))
    made = _one(f"{_string('s.agency_id')} IS NOT NULL AND {_string('s.dataflow_id')} IS NOT NULL", endpoint)
    return _let(_get("m.sdmx", kind), "s", f"filter({made}, r -> r.url IS NOT NULL)")


@cache
def resources_sql(metadata: str) -> str:
    """All resources of a metadata variant, in a fixed order of shapes."""
    there = lambda key, made: f"CASE WHEN m.`{key}` IS NOT NULL THEN {made} ELSE {NO_RESOURCES} END"
    table = _let(there("metas", _opendatasoft_table()), "o", f"CASE WHEN size(o) > 0 THEN o ELSE {there('resource', _socrata_table())} END")
    listed = _kept(f"transform({_nodes('m', NUMBERED)}, n -> {_node()})")
    shapes = [table, there("stac_version", _stac_assets()), there("properties", _arcgis_service()), there("sdmx", _sdmx_endpoint()), listed]
    any_shape = f"coalesce({_let(_get(metadata, METADATA), 'm', f'concat({", ".join(shapes)})')}, {NO_RESOURCES})"
    # most metadata holds lists of resources with texts alone; they are read at once
    plain = _kept(f"transform(ns, n -> {_node(_plain_texts, _plain_field_list)})")
    only_lists = " AND ".join(f"p.`{k}` IS NULL" for k in TABLE_KEYS)
    chosen = f"CASE WHEN {only_lists} AND forall(ns, n -> {_all_strings('n')}) THEN {plain} ELSE {any_shape} END"
    return _let(_get(metadata, PLAIN), "p", _let(_nodes("p", PLAIN_NUMBERED), "ns", chosen))


def _nodes(metadata: str, kind: str) -> str:
    """The nodes of all lists, in their fixed order."""
    lists = ", ".join(f"cast({metadata}.`{k}` AS array<{kind}>)" for k in LISTS)
    return f"filter(flatten(filter(array({lists}), x -> x IS NOT NULL)), n -> n IS NOT NULL)"


def resources_of(name: str) -> Column:
    """The resources of the metadata variant in the named column."""
    return F.expr(resources_sql(f"`{name}`"))


def with_resources(catalog: DataFrame) -> DataFrame:
    """The catalog with `resources`, derived from its metadata JSON; rows whose metadata is no JSON have none.

    All shapes are SQL expressions, so the derivation needs neither Python nor a shuffle.
    """
    parsed = catalog.withColumn("__metadata", V.parsed(F.col("metadata")))
    return parsed.withColumn("resources", resources_of("__metadata")).drop("__metadata")


def summaries(full: Column) -> Column:
    """The resources as snapshots have them, with the number of fields instead of the fields."""
    return F.transform(full, lambda r: F.struct(r["name"].alias("name"), r["format"].alias("format"), r["media_type"].alias("media_type"), r["url"].alias("url"), F.size(r["fields"]).cast("bigint").alias("field_count")))
