"""Landed pages of each portal family, made from the documents: a record for each document, fifty ids to a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.fixtures import read

PER_PAGE = 50


def _q(value: str) -> str:
    """SQL for a text as a JSON string."""
    wrapped = f"to_json(named_struct('x', {value}))"
    return f"substr({wrapped}, 6, length({wrapped}) - 6)"


T, X_, ID = _q("t"), _q("x"), "cast(doc_id as string)"

#: SQL for the JSON of one record, by family.
NODES = {
    "ckan": f"""concat('{{"id":"', doc_id, '","name":"n', doc_id, '","title":',
        CASE doc_id % 3 WHEN 0 THEN {T} WHEN 1 THEN concat('{{"de":"D","en":', {T}, '}}') ELSE concat('{{"fr":', {T}, ',"de":""}}') END,
        CASE doc_id % 4 WHEN 0 THEN concat(',"notes":', {X_}) WHEN 1 THEN concat(',"notes":null,"description":', {X_}) WHEN 3 THEN ',"notes":""' ELSE '' END,
        ',"metadata_modified":"2026-01-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'), 'T10:00:00Z"}}')""",
    "data_json": f"""concat('{{"identifier":',
        CASE doc_id % 5 WHEN 0 THEN concat('"https://id.example.org/', doc_id, '"') WHEN 1 THEN concat('{{"en":"', doc_id, '"}}') ELSE concat('"', doc_id, '"') END,
        ',"title":', CASE WHEN doc_id % 7 = 0 THEN concat('[{{"fr":', {T}, '}}]') ELSE {T} END,
        CASE doc_id % 3 WHEN 0 THEN concat(',"landingPage":"https://page.example.org/', doc_id, '"') WHEN 1 THEN ',"landingPage":"no url"' ELSE '' END,
        CASE WHEN doc_id % 2 = 0 THEN concat(',"description":[', {X_}, ']') ELSE '' END,
        CASE doc_id % 3 WHEN 0 THEN ',"modified":"2026-01-15"' WHEN 1 THEN ',"modified":"2026-01-15T10:00:00+02:00"' ELSE ',"modified":"soon"' END, '}}')""",
    "socrata": f"""concat('{{"resource":{{"id":"', lpad(cast(doc_id % 10000 as string), 4, '0'), '-', lpad(cast(doc_id div 10000 as string), 4, '0'), '","name":', {T},
        ',"description":', {_q("concat('<p>', x, '</p>')")}, ',"updatedAt":"bad","data_updated_at":"2026-02-01T00:00:00Z"',
        CASE WHEN doc_id % 3 = 0 THEN ',"attribution":" Office "' ELSE '' END, '}},"classification":{{"tags":["A","a","b"],"domain_tags":[" b ",""]',
        CASE WHEN doc_id % 2 = 0 THEN ',"categories":["", "cat"]' ELSE ',"domain_category":"dom"' END, '}},"metadata":{{"domain":"data.example.org"}},"owner":{{"display_name":"Owner"}}',
        CASE doc_id % 3 WHEN 0 THEN concat(',"link":"https://link.example.org/', doc_id, '"') WHEN 1 THEN concat(',"link":"no url","permalink":"https://perma.example.org/', doc_id, '"') ELSE '' END, '}}')""",
    "opendatasoft": f"""concat('{{"dataset_id":"ods-', doc_id, '","fields":[],"metas":{{"default":{{"title":',
        CASE WHEN doc_id % 6 = 0 THEN '"  "' ELSE {T} END, ',"description":', {_q("concat('<div><b>', x, '</b></div>')")},
        ',"keyword":', CASE WHEN doc_id % 2 = 0 THEN '"single"' ELSE '["K1","k1","K2"]' END, ',"theme":["T","t"],"modified":"2026-03-01T00:00:00+00:00"',
        CASE WHEN doc_id % 3 = 0 THEN ',"publisher":"Pub"' ELSE '' END, '}},"dcat":{{"creator":"Creator"}}}}}}')""",
    "arcgis": f"""concat('{{', CASE WHEN doc_id % 2 = 0 THEN concat('"id":"a', doc_id, '",') ELSE '' END, '"properties":{{"id":"a', doc_id, '","title":',
        CASE WHEN doc_id % 5 = 0 THEN '"   "' ELSE {T} END, CASE WHEN doc_id % 3 = 0 THEN concat(',"snippet":', {X_}) ELSE concat(',"description":', {_q("concat('<p>', x, '<br/></p>')")}) END,
        ',"modified":', 1700000000000 + doc_id * 1000, ',"categories":["/Categories/Env","/categories/env","Env"],"tags":["x","X"],"owner":"me"}}}}')""",
    "stac": f"""concat('{{"stac_version":"1.0.0","id":"s', doc_id, '"', CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(',"title":', {T}) END, ',"description":', {X_},
        ',"links":[', CASE doc_id % 3 WHEN 0 THEN concat('{{"rel":"self","href":"./c/', doc_id, '"}},{{"rel":"about","href":"https://about.example.org/', doc_id, '"}}')
          WHEN 1 THEN concat('{{"rel":"canonical","href":"/abs/', doc_id, '"}}') ELSE '' END, '],"assets":{{"b":{{"href":"https://x/b","type":"text/csv"}},"a":{{"href":"https://x/a","title":"A"}}}}}}')""",
    "dcat": f"""concat('{{"@id":"https://udata.example.org/datasets/d', doc_id, '/","@type":', CASE WHEN doc_id % 2 = 0 THEN '"dcat:Dataset"' ELSE '["x","dcat:Dataset"]' END,
        ',"dct:title":', CASE doc_id % 3 WHEN 0 THEN {T} WHEN 1 THEN concat('{{"@value":', {T}, '}}') ELSE concat('[{{"@language":"fr","@value":"F"}},{{"@language":"en-GB","@value":', {T}, '}}]') END,
        CASE WHEN doc_id % 4 = 0 THEN concat(',"identifier":"i', doc_id, '"') ELSE '' END,
        ',"dcat:distribution":[{{"@id":"_:r', doc_id, '"}},"_:missing"]}},{{"@id":"_:r', doc_id, '","format":"CSV","downloadURL":{{"@id":"https://x/', doc_id, '.csv"}}}}')""",
    "sparql": f"""concat('{{"dataset":{{"type":"uri","value":"https://sparql.example.org/d/', doc_id, '"}},"title":{{"type":"literal","xml:lang":"de","value":"D"}}}},',
        '{{"dataset":{{"type":"uri","value":"https://sparql.example.org/d/', doc_id, '"}},"title":{{"type":"literal","xml:lang":"en","value":', {T}, '}}',
        CASE WHEN doc_id % 3 = 0 THEN concat(',"identifier":{{"type":"literal","value":"i', doc_id div 2, '"}}') ELSE '' END,
        ',"description":{{"type":"literal","value":', {X_}, '}},"publisher":{{"type":"uri","value":"https://p.example.org/', source, '"}}}}')""",
}
AROUND = {
    "ckan": ('{"success":true,"result":{"count":1000,"results":[', "]}}"),
    "data_json": ('{"dataset":[', "]}"),
    "dcat": ('{"@graph":[{"@type":"hydra:PartialCollectionView"},', "]}"),
    "sparql": ('{"head":{"vars":[]},"results":{"bindings":[', "]}}"),
    "socrata": ('{"resultSetSize":1000,"results":[', "]}"),
    "opendatasoft": ('{"total_count":1000,"results":[', "]}"),
    "arcgis": ('{"type":"FeatureCollection","features":[', "]}"),
    "stac": ('{"links":[],"collections":[', "]}"),
}


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, t and x: documents with a short title, and up to 200 characters of description."""
    blank, signs = r"[ \t\n\f\r]+", "[<>&]"
    clean = lambda a, n: F.trim(F.regexp_replace(F.regexp_replace(F.substring("text", a, n), signs, " "), blank, " "))
    return read(spark, sf_dir, "documents").select("doc_id", "source", clean(1, 40).alias("t"), clean(41, 200).alias("x")).where("t <> ''")


def pages(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """portal_url, language, url_template, page and body of a family's landed pages."""
    head, tail = AROUND[family]
    rows = source_rows(spark, sf_dir).withColumn("page", F.expr(f"cast(doc_id div {PER_PAGE} as int)")).withColumn("json", F.expr(NODES[family]))
    joined = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "json"))).alias("all"))
    body = F.concat(F.lit(head), F.array_join(F.transform("all", lambda r: r["json"]), ","), F.lit(tail))
    if family == "data_json":
        body = F.when(F.col("page") % 2 == 1, F.concat(F.lit("["), F.array_join(F.transform("all", lambda r: r["json"]), ","), F.lit("]"))).otherwise(body)
    template = F.when((F.col("page") % 2 == 0) & F.lit(family == "ckan"), "https://t.example.org/{id}/{name}")
    return joined.select(F.lit(f"https://{family}.example.org/").alias("portal_url"), F.lit("en").alias("language"), template.alias("url_template"), "page", body.alias("body"))


def distribution_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of SPARQL bindings that describe two distributions of each document's dataset."""
    node = """concat_ws(',', transform(array(
        concat('"https://x/', doc_id, '/a"|http://purl.org/dc/terms/title|literal|', 'A|en'), concat('"https://x/', doc_id, '/a"|http://purl.org/dc/terms/title|literal|', 'B|de'),
        concat('"https://x/', doc_id, '/a"|http://purl.org/dc/terms/title|literal|', 'A|en'), concat('"https://x/', doc_id, '/a"|http://www.w3.org/ns/dcat#downloadURL|uri|', 'https://x/f|'),
        concat('"_:b', doc_id, '"|http://purl.org/dc/terms/format|uri|', 'https://f/CSV|'), concat('"_:b', doc_id, '"|http://other/|uri|', 'https://f/CSV|')),
      b -> concat('{"dataset":{"type":"uri","value":"https://sparql.example.org/d/', doc_id, '"},"distribution":{"type":"uri","value":', split_part(b, '|', 1), '},"property":{"type":"uri","value":"', split_part(b, '|', 2),
        '"},"value":{"type":"', split_part(b, '|', 3), '","value":"', split_part(b, '|', 4), '"', if(split_part(b, '|', 5) = '', '', concat(',"xml:lang":"', split_part(b, '|', 5), '"')), '}}')))"""
    head, tail = AROUND["sparql"]
    rows = source_rows(spark, sf_dir).withColumn("page", F.expr(f"cast(doc_id div {PER_PAGE} as int)")).withColumn("json", F.expr(node))
    joined = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "json"))).alias("all"))
    body = F.concat(F.lit(head), F.array_join(F.transform("all", lambda r: r["json"]), ","), F.lit(tail))
    return joined.select(F.lit("https://sparql.example.org/").alias("portal_url"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("url_template"), "page", body.alias("body"))


def sdmx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SDMX structure messages with mixed prefixes; every eleventh page is an error message."""
    flow = """concat('<str:Dataflow id="F', doc_id, '" agencyID="AG" version="1.', doc_id % 3, '"><c:Annotations><c:Annotation><c:AnnotationType>CREATED</c:AnnotationType><c:AnnotationTitle>2020-01-01</c:AnnotationTitle></c:Annotation>',
      if(doc_id % 2 = 0, '<c:Annotation><c:AnnotationType>UPDATE_DATA</c:AnnotationType><c:AnnotationTitle>2026-01-05T10:00:00+0200</c:AnnotationTitle></c:Annotation>', ''),
      '</c:Annotations><c:Name xml:lang="fr">F</c:Name><c:Name xml:lang="en">', t, '</c:Name><str:Structure><Ref id="S', doc_id, '"/></str:Structure></str:Dataflow>')"""
    rows = source_rows(spark, sf_dir).withColumn("page", F.expr(f"cast(doc_id div {PER_PAGE} as int)")).withColumn("xml", F.expr(flow))
    joined = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "xml"))).alias("all"))
    head = '<mes:Structure xmlns:mes="m" xmlns:str="s" xmlns:c="c"><mes:Structures><str:Dataflows>'
    body = F.concat(F.lit(head), F.array_join(F.transform("all", lambda r: r["xml"]), ""), F.lit("</str:Dataflows></mes:Structures></mes:Structure>"))
    body = F.when(F.col("page") % 11 == 10, "<mes:Error xmlns:mes='m'/>").otherwise(body)
    return joined.select(F.lit("https://sdmx.example.org/").alias("portal_url"), F.lit("en").alias("language"), "page", body.alias("body"))


def csw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSW GetRecords pages: ISO 19139 for even pages, Dublin Core for odd ones; each seventh declares a record too many."""
    iso = """concat('<g:MD_Metadata><g:fileIdentifier><o:CharacterString>c', doc_id, '</o:CharacterString></g:fileIdentifier><g:hierarchyLevel><g:MD_ScopeCode codeListValue="', element_at(array('dataset', 'series', 'service', 'model', 'x'), cast(doc_id % 5 + 1 as int)), '"/></g:hierarchyLevel>',
      '<g:dateStamp>2026-01-0', doc_id % 9 + 1, '</g:dateStamp><g:identificationInfo><g:MD_DataIdentification><g:citation><g:CI_Citation><g:title><o:CharacterString>', t, '</o:CharacterString></g:title></g:CI_Citation></g:citation><g:abstract><o:CharacterString>', x, '</o:CharacterString></g:abstract></g:MD_DataIdentification></g:identificationInfo>',
      '<g:CI_OnlineResource><g:linkage><g:URL>https://x/', doc_id, '.zip</g:URL></g:linkage><g:protocol><o:CharacterString>WWW:DOWNLOAD-1.0-http--download</o:CharacterString></g:protocol></g:CI_OnlineResource>',
      if(doc_id % 2 = 0, concat('<g:CI_OnlineResource><g:linkage><g:URL>https://x/page/', doc_id, '</g:URL></g:linkage><g:protocol><o:CharacterString>OGC:WMS</o:CharacterString></g:protocol></g:CI_OnlineResource>'), ''), '</g:MD_Metadata>')"""
    core = """concat('<w:Record><dc:identifier>c', doc_id, '</dc:identifier><dc:title>', t, '</dc:title><dc:type>dataset</dc:type><dct:modified>2026-01-0', doc_id % 9 + 1, '</dct:modified><dct:abstract>', x, '</dct:abstract><dct:references scheme="WWW:LINK">https://x/page/', doc_id, '</dct:references></w:Record>')"""
    rows = source_rows(spark, sf_dir).withColumn("page", F.expr(f"cast(doc_id div {PER_PAGE} as int)"))
    rows = rows.withColumn("xml", F.when(F.col("page") % 2 == 0, F.expr(iso)).otherwise(F.expr(core)))
    joined = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "xml"))).alias("all"))
    returned = F.size("all") + (F.col("page") % 7 == 6).cast("int")
    head = F.concat(F.lit('<w:GetRecordsResponse xmlns:w="w" xmlns:g="g" xmlns:o="o" xmlns:dc="dc" xmlns:dct="dct"><w:SearchResults numberOfRecordsReturned="'), returned.cast("string"), F.lit('">'))
    body = F.concat(head, F.array_join(F.transform("all", lambda r: r["xml"]), ""), F.lit("</w:SearchResults></w:GetRecordsResponse>"))
    return joined.select(F.lit("https://csw.example.org/").alias("portal_url"), F.lit("en").alias("language"), "page", body.alias("body"))
