"""XML catalog pages (SDMX-ML dataflows, CSW records) as rows.

Pages mix namespace prefixes, so elements are matched by local name. Splitting is the one
step that needs Python; it runs on Arrow batches of pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

FLOW = "portal_url string, language string, agency string, flow_id string, version string, names map<string,string>, descriptions map<string,string>, annotations array<struct<id:string,type:string,title:string,url:string,texts:map<string,string>>>, urn string, is_final boolean, structure_url string, structure struct<id:string,agency_id:string,version:string,class:string,urn:string>, url_template string, error string"
RECORD = "portal_url string, language string, declared bigint, parsed bigint, identifier string, title string, description string, scope string, modified string, links array<struct<url:string,name:string,protocol:string,downloadable:boolean>>, keywords array<string>, bbox array<double>, organization string, error string"
_LINK = pa.struct([("url", pa.string()), ("name", pa.string()), ("protocol", pa.string()), ("downloadable", pa.bool_())])
_FLOW = pa.schema(
    [("portal_url", pa.string()), ("language", pa.string()), ("agency", pa.string()), ("flow_id", pa.string()), ("version", pa.string()),
     ("names", pa.map_(pa.string(), pa.string())), ("descriptions", pa.map_(pa.string(), pa.string())),
     ("annotations", pa.list_(pa.struct([*((k, pa.string()) for k in ("id", "type", "title", "url")), ("texts", pa.map_(pa.string(), pa.string()))]))),
     ("urn", pa.string()), ("is_final", pa.bool_()), ("structure_url", pa.string()), ("structure", pa.struct([(k, pa.string()) for k in ("id", "agency_id", "version", "class", "urn")])),
     ("url_template", pa.string()), ("error", pa.string())]
)
_RECORD = pa.schema(
    [("portal_url", pa.string()), ("language", pa.string()), ("declared", pa.int64()), ("parsed", pa.int64()), ("identifier", pa.string()), ("title", pa.string()),
     ("description", pa.string()), ("scope", pa.string()), ("modified", pa.string()), ("links", pa.list_(_LINK)), ("keywords", pa.list_(pa.string())),
     ("bbox", pa.list_(pa.float64())), ("organization", pa.string()), ("error", pa.string())]
)
#: Words of a protocol that offers a download (fixed values).
DOWNLOAD = ("download", "file")


#: Rows that are held as Python objects before they go out; a page's own rows are held at once.
PIECE = 500


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The batches' pages, one at a time: only one is held as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _in_pieces(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == PIECE:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _all(element: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in element.iter() if local(x) == name)


def _children(element: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in element if local(x) == name]


def _text(element: ElementTree.Element | None) -> str | None:
    return " ".join("".join(element.itertext()).split()) or None if element is not None else None


def _first(element: ElementTree.Element, *path: str) -> ElementTree.Element | None:
    """The first element along a path of local names, each at any depth."""
    for name in path:
        element = next((x for x in _all(element, name) if x is not element), None)
        if element is None:
            return None
    return element


def _language_map(elements: list[ElementTree.Element]) -> dict[str, str]:
    found = {}
    for x in elements:
        lang = next((v for k, v in x.attrib.items() if k.rpartition("}")[2] == "lang"), "").lower()
        if (text := _text(x)) and lang not in found:
            found[lang] = text
    return found


def _flow(x: ElementTree.Element) -> dict:
    urn = x.get("urn") or ""
    agency, flow, version = x.get("agencyID"), x.get("id"), x.get("version")
    if (not agency or not flow) and "=" in urn:
        head, _, tail = urn.rpartition("=")[2].partition("(")
        a, _, i = head.partition(":")
        agency, flow, version = agency or a or None, flow or i or None, version or tail.rstrip(")") or None
    child = lambda n, name: _text(next(iter(_children(n, name)), None))
    notes = [
        {"id": n.get("id"), "type": child(n, "AnnotationType"), "title": child(n, "AnnotationTitle"), "url": child(n, "AnnotationURL"), "texts": list(_language_map(_children(n, "AnnotationText")).items())}
        for group in _children(x, "Annotations") for n in _children(group, "Annotation")
    ]
    structure = next(iter(_children(x, "Structure")), None)
    reference = next(iter(_children(structure, "Ref")), None) if structure is not None else None
    refers = lambda name: reference.get(name) if reference is not None else None
    return {
        "agency": agency, "flow_id": flow, "version": version, "urn": urn or None, "is_final": None if x.get("isFinal") is None else x.get("isFinal") == "true", "structure_url": x.get("structureURL"),
        "names": list(_language_map(_children(x, "Name")).items()), "descriptions": list(_language_map(_children(x, "Description")).items()), "annotations": notes,
        "structure": None if structure is None else {"id": refers("id"), "agency_id": refers("agencyID"), "version": refers("version"), "class": refers("class"), "urn": _text(structure)},
    }


def dataflows(pages: DataFrame) -> DataFrame:
    """One row for each Dataflow below Dataflows of a page (portal_url, language, body, and url_template if there).

    Pages that don't parse, are error messages or have another root give one row with error.
    """

    def flows(page: dict) -> list[dict]:
        base = {"portal_url": page["portal_url"], "language": page["language"], "url_template": page.get("url_template")}
        try:
            root = ElementTree.fromstring(page["body"] or "")
            if local(root) != "Structure":
                raise ValueError(f"no structure message but {local(root)}")
            return [base | _flow(x) for found in _all(root, "Dataflows") for x in _children(found, "Dataflow")]
        except (ElementTree.ParseError, ValueError) as problem:
            return [base | {"error": str(problem)}]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_pieces((row for page in _pages(batches) for row in flows(page)), _FLOW)

    template = ["url_template"] if "url_template" in pages.columns else []
    return pages.select("portal_url", "language", "body", *template).mapInArrow(split, FLOW)


def _localised(element: ElementTree.Element | None, language: str) -> str | None:
    """The localised string of the language, else the character string or anchor, else any text."""
    if element is None:
        return None
    base = language.lower().split("-")[0]
    for x in _all(element, "LocalisedCharacterString"):
        if (x.get("locale") or "").lstrip("#").lower().startswith(base) and _text(x):
            return _text(x)
    for name in ("CharacterString", "Anchor"):
        if (found := next(_all(element, name), None)) is not None and _text(found):
            return _text(found)
    return _text(element)


def _number(element: ElementTree.Element | None) -> float | None:
    try:
        return float(_text(element) or "")
    except ValueError:
        return None


def _link(url: str | None, name: str | None, protocol: str | None) -> dict | None:
    if not url:
        return None
    return {"url": url, "name": name, "protocol": protocol, "downloadable": any(w in (protocol or "").lower() for w in DOWNLOAD)}


def _iso(x: ElementTree.Element, language: str) -> dict:
    links = [_link(_text(_first(o, "URL")), _localised(_first(o, "name"), language), _localised(_first(o, "protocol"), language)) for o in _all(x, "CI_OnlineResource")]
    box = None
    for extent in _all(x, "EX_GeographicBoundingBox"):
        sides = [_number(_first(extent, s)) for s in ("westBoundLongitude", "southBoundLatitude", "eastBoundLongitude", "northBoundLatitude")]
        if None not in sides:
            box = sides
            break
    scope = next(_all(x, "MD_ScopeCode"), None)
    identification = _first(x, "identificationInfo")
    title = _first(identification, "citation", "title") if identification is not None else None
    return {
        "identifier": _localised(_first(x, "fileIdentifier"), language), "title": _localised(title, language), "description": _localised(_first(identification, "abstract") if identification is not None else None, language),
        "scope": scope.get("codeListValue") if scope is not None else None, "modified": _text(_first(x, "dateStamp")), "links": [k for k in links if k],
        "keywords": [t for k in _all(x, "keyword") if (t := _localised(k, language))], "bbox": box, "organization": _localised(_first(x, "organisationName"), language),
    }


def _dublin_core(x: ElementTree.Element) -> dict:
    first = lambda *names: next((t for n in names for e in _all(x, n) if (t := _text(e))), None)
    links = [_link(_text(r), None, r.get("scheme") or r.get("protocol")) for n in ("references", "URI") for r in _all(x, n)]
    box = None
    lower, upper = ((_text(next(_all(x, n), None)) or "").split() for n in ("LowerCorner", "UpperCorner"))
    try:
        if len(lower) >= 2 and len(upper) >= 2:
            box = [float(v) for v in (*lower[:2], *upper[:2])]
    except ValueError:
        box = None
    return {"identifier": first("identifier"), "title": first("title"), "description": first("abstract", "description"), "scope": first("type"), "modified": first("modified", "date"), "links": [k for k in links if k], "keywords": [t for k in _all(x, "subject") if (t := _text(k))], "bbox": box, "organization": first("publisher", "creator")}


def _csw(body: str | None) -> tuple[int, list[ElementTree.Element]]:
    """The number of records that a GetRecords page says it returns, and those that it holds."""
    root = ElementTree.fromstring(body or "")
    results = next(_all(root, "SearchResults"), None)
    if local(root) != "GetRecordsResponse" or results is None:
        raise ValueError(f"no GetRecords response but {local(root)}")
    found = [x for x in results if local(x) in ("MD_Metadata", "Record", "SummaryRecord")]
    return int(results.get("numberOfRecordsReturned") or len(found)), found


def csw_counts(pages: DataFrame) -> DataFrame:
    """portal_url, page, declared and parsed (see csw_records()) of each GetRecords page, with error where it doesn't parse."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(2):
                try:
                    declared, found = _csw(body.as_py())
                    rows.append((declared, len(found), None))
                except (ElementTree.ParseError, ValueError) as problem:
                    rows.append((None, None, str(problem)))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["portal_url", "page", "declared", "parsed", "error"])

    kind = pages.schema["page"].dataType.simpleString()
    return pages.select("portal_url", "page", "body").mapInArrow(count, f"portal_url string, page {kind}, declared bigint, parsed bigint, error string")


def csw_records(pages: DataFrame) -> DataFrame:
    """One row for each metadata record of a GetRecords page, ISO 19139 or Dublin Core.

    declared is the number of records that the page says it returns and parsed how many it
    holds; pages that don't parse or have another root give one row with error.
    """

    def found_on(page: dict) -> list[dict]:
        base = {"portal_url": page["portal_url"], "language": page["language"]}
        try:
            declared, found = _csw(page["body"])
            counts = {"declared": declared, "parsed": len(found)}
            return [base | counts | (_iso(x, page["language"]) if local(x) == "MD_Metadata" else _dublin_core(x)) for x in found]
        except (ElementTree.ParseError, ValueError) as problem:
            return [base | {"error": str(problem)}]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_pieces((row for page in _pages(batches) for row in found_on(page)), _RECORD)

    return pages.select("portal_url", "language", "body").mapInArrow(split, RECORD)


