"""Reading JSON of changing shape: a field may be a string, an object, a list or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import non_blank

Entry = "map<string,variant>"
#: Beginnings of what a number, a truth value, an object or a list is read as; any other text was a string.
UNSURE = r"^([-0-9{\[]|true$|false$|Infinity$|NaN$)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def parsed(json: Column) -> Column:
    """The JSON text as a variant, null if it is no JSON."""
    return F.try_parse_json(json)


def sign(value: Column) -> Column:
    """The first sign of a variant's JSON, which tells its shape: a quote, {, [, n(ull) or another."""
    return F.substring(F.to_json(value), 1, 1)


def at(value: Column, path: str) -> Column:
    """Q3: the part at a path (`a.b`), as a variant; null where it is absent."""
    return F.try_variant_get(value, "$." + path, "variant")


def string_of(value: Column) -> Column:
    """The text of a variant that is a string, null for any other."""
    return let(value, lambda v: F.when(sign(v) == '"', F.try_variant_get(v, "$", "string")))


def string_at(value: Column, path: str) -> Column:
    """string_of the part at a path; what is read as a string tells most strings at once, so the part isn't copied and written as JSON."""
    text = F.try_variant_get(value, "$." + path, "string")
    return F.when(text.rlike(UNSURE), string_of(at(value, path))).otherwise(text)


def list_of(value: Column) -> Column:
    """The elements of a variant that is a list, null for any other."""
    return F.try_variant_get(value, "$", "array<variant>")


def entries_of(value: Column) -> Column:
    """Key and value of each field of an object, by key; null for any other."""
    fields = F.try_variant_get(value, "$", Entry)
    keys = F.array_sort(F.map_keys(fields))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), fields[k].alias("value")))


def is_object(value: Column) -> Column:
    """Read as a struct, which only an object can be, and not as JSON, which writes all of it."""
    return F.try_variant_get(value, "$", "struct<x:variant>").isNotNull()


def is_list(value: Column) -> Column:
    return list_of(value).isNotNull()


def present(value: Column, path: str) -> Column:
    """Whether a field is there, be it null."""
    return at(value, path).isNotNull()


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _string(bound: Column) -> Column:
    """string_of for a value that is already bound to a name."""
    return F.when(sign(bound) == '"', F.try_variant_get(bound, "$", "string"))


def _usable(bound: Column, keys: tuple[str, ...]) -> Column:
    """The non-blank text of a bound string, or of an object's first key that has one, or of a list's first such element."""
    plain = non_blank(F.try_variant_get(bound, "$", "string"))
    shape = sign(bound)
    of_object = lambda v: F.coalesce(*[non_blank(_string(at(v, k))) for k in keys])
    element = lambda v: F.when(sign(v) == '"', non_blank(F.try_variant_get(v, "$", "string"))).otherwise(of_object(v))
    of_list = _first(F.filter(F.transform(F.try_variant_get(bound, "$", "array<variant>"), element), lambda t: t.isNotNull()))
    return F.when(shape == '"', plain).when(shape == "{", of_object(bound)).when(shape == "[", of_list)


def usable_text(value: Column) -> Column:
    """A non-blank string, or that of {"@value": ...}, or of a list's first element that has one."""
    return let(value, lambda v: _usable(v, ("@value",)))


def reference(value: Column) -> Column:
    """The @id, the text or the @value of a variant, or that of a list's first element that has one."""
    return let(value, lambda v: _usable(v, ("@id", "@value")))


def first_usable(values: list[Column], *, references: bool = False) -> Column:
    """The first usable text (or reference) of several variants; the rule stands once in the plan, not once for each.

    What is read as a string tells most strings at once; only what might be another shape is looked at closer.
    """
    keys = ("@id", "@value") if references else ("@value",)
    there = F.filter(F.array(*values), lambda v: v.isNotNull())
    read = F.transform(there, lambda v: F.struct(v.alias("v"), F.try_variant_get(v, "$", "string").alias("t")))
    text = lambda p: F.when(p["t"].rlike(UNSURE), _usable(p["v"], keys)).otherwise(non_blank(p["t"]))
    return _first(F.filter(F.transform(read, text), lambda t: t.isNotNull()))


def first_text(value: Column, keys: list[str]) -> Column:
    """Q1: the first usable text among the keys."""
    return first_usable([at(value, k) for k in keys])


def first_reference(value: Column, keys: list[str]) -> Column:
    """Q2: like first_text, but an {"@id": ...} comes before."""
    return first_usable([at(value, k) for k in keys], references=True)


def localized(value: Column, language: Column) -> Column:
    """L1: a plain string, or of a map the preferred, the English, else the first non-empty text by key; '' if none."""
    fields = F.transform(entries_of(value), lambda e: F.struct(e["key"].alias("key"), string_of(e["value"]).alias("text")))
    of = lambda some, k: _first(F.filter(some, lambda e: e["key"] == k))["text"]
    chosen = let(F.filter(fields, lambda e: e["text"] != ""), lambda some: F.coalesce(of(some, language), of(some, F.lit("en")), _first(some)["text"]))
    return F.coalesce(string_of(value), chosen, F.lit(""))


def jsonld_text(value: Column, language: Column) -> Column:
    """L2: a string, {"@value"}, or of a list the text of the exact language, its base, English, else the first."""
    as_list = F.coalesce(list_of(value), F.array(value))
    texts = F.transform(
        as_list,
        lambda v: F.struct(F.lower(string_at(v, "@language")).alias("lang"), F.coalesce(string_of(v), string_at(v, "@value")).alias("text")),
    )
    base = lambda x: F.split_part(x, F.lit("-"), F.lit(1))
    wanted = F.lower(language)
    exact = lambda some, k: _first(F.filter(some, lambda t: t["lang"] == k))["text"]
    near = lambda some, k: _first(F.filter(some, lambda t: base(t["lang"]) == base(k)))["text"]
    choose = lambda some: F.coalesce(exact(some, wanted), near(some, wanted), exact(some, F.lit("en")), near(some, F.lit("en")), _first(some)["text"])
    chosen = let(F.filter(texts, lambda t: t["text"] != ""), choose)
    return F.coalesce(F.when(value.isNotNull(), chosen), F.lit(""))


def dcat_us_text(value: Column, language: Column) -> Column:
    """L3: a string; of an object the language, English, else the first string; of a list the first that has one."""

    def single(v: Column) -> Column:
        texts = F.filter(F.transform(entries_of(v), lambda e: string_of(e["value"])), lambda t: t.isNotNull())
        fields = F.try_variant_get(v, "$", Entry)
        return F.coalesce(string_of(v), string_of(fields[language]), string_at(v, "en"), _first(texts))

    return F.coalesce(single(value), _first(F.filter(F.transform(list_of(value), single), lambda t: t.isNotNull())))


def language_text(texts: Column, language: Column) -> Column:
    """L4: of a map language -> text the one of the same base language, of English, else any, each time the first by key."""
    entries = F.array_sort(F.map_entries(texts))
    base = lambda k: F.split(F.lower(k), "[-_]")[0]
    of = lambda k: _first(F.filter(entries, lambda e: base(e["key"]) == k))["value"]
    return F.coalesce(of(base(language)), of(F.lit("en")), _first(entries)["value"])


def text_list(value: Column) -> Column:
    """The non-blank texts of a string, or of a list of strings or of objects with a name."""
    one = lambda v: F.coalesce(non_blank(string_of(v)), non_blank(string_at(v, "name")))
    as_list = F.coalesce(list_of(value), F.array(value))
    return F.coalesce(F.filter(F.transform(as_list, one), lambda t: t.isNotNull()), F.array().cast("array<string>"))


def deduplicated(texts: Column) -> Column:
    """Y2: the list without later texts that equal an earlier one but for case."""
    return F.filter(texts, lambda t, i: ~F.exists(F.slice(texts, F.lit(1), i), lambda s: F.lower(s) == F.lower(t)))


def without_categories(texts: Column) -> Column:
    """Y3."""
    return F.transform(texts, lambda t: F.regexp_replace(t, "^/Categories/", ""))


def zipped_columns(resource: Column) -> Column:
    """Field name, datatype and description from ragged parallel lists; fields without a name are left out."""
    part = lambda k: F.coalesce(F.transform(list_of(at(resource, k)), string_of), F.array().cast("array<string>"))
    zipped = F.arrays_zip(part("columns_field_name").alias("a"), part("columns_name").alias("b"), part("columns_datatype").alias("c"), part("columns_description").alias("d"))

    def field(z: Column) -> Column:
        label = non_blank(z["b"])
        name = F.coalesce(non_blank(z["a"]), label)
        return F.struct(name.alias("name"), non_blank(z["c"]).alias("type"), F.coalesce(non_blank(z["d"]), F.when(label != name, label)).alias("description"))

    return F.filter(F.transform(zipped, field), lambda f: f["name"].isNotNull())


def tags(metadata: Column) -> Column:
    """M1: names of the tag objects (display_name only where name is absent), joined; plain strings don't count."""
    one = lambda t: F.when(present(t, "name"), string_at(t, "name")).otherwise(string_at(t, "display_name"))
    names = F.filter(F.transform(list_of(at(metadata, "tags")), one), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def either(value: Column, first: str, second: str) -> Column:
    """The string at first; at second only where first is absent; else ''."""
    return F.coalesce(F.when(present(value, first), string_at(value, first)).otherwise(string_at(value, second)), F.lit(""))


def organization(metadata: Column) -> Column:
    """M2."""
    return either(at(metadata, "organization"), "title", "name")


def license_name(metadata: Column) -> Column:
    """M3."""
    return either(metadata, "license_title", "license_id")


def text_or_empty(metadata: Column, key: str) -> Column:
    """M4."""
    return F.coalesce(string_at(metadata, key), F.lit(""))


def term_json(term: Column) -> Column:
    """Q4: an RDF term (value, type, lang, datatype) as JSON without its null parts."""
    return F.to_json(F.struct(term["type"].alias("type"), term["value"].alias("value"), term["lang"].alias("xml:lang"), term["datatype"].alias("datatype")))


def term_jsonld(term: Column) -> Column:
    """Q5: an IRI as {"@id"}, a literal as {"@value"} with its language or datatype, as JSON."""
    literal = F.struct(term["value"].alias("@value"), term["lang"].alias("@language"), term["datatype"].alias("@type"))
    return F.when(term["type"] == "uri", F.to_json(F.struct(term["value"].alias("@id")))).otherwise(F.to_json(literal))


def collapsed(json: Column) -> Column:
    """Q5: a list of JSON texts as nothing, the one, or a JSON list."""
    return F.when(F.size(json) == 1, json[0]).when(F.size(json) > 1, F.concat(F.lit("["), F.array_join(json, ","), F.lit("]")))


def bounding_box(west: Column, south: Column, east: Column, north: Column, lower: Column, upper: Column) -> Column:
    """Q6: [w, s, e, n] of four bounds if all are there, else of two corners ("x y")."""
    number = lambda text, i: F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(i)).try_cast("double")
    complete = west.isNotNull() & south.isNotNull() & east.isNotNull() & north.isNotNull()
    corners = F.array(number(lower, 1), number(lower, 2), number(upper, 1), number(upper, 2))
    whole = ~F.exists(corners, lambda x: x.isNull())
    return F.when(complete, F.array(west, south, east, north)).when(whole, corners)
