"""Paragraphs of article XML. Spark's XML functions lose mixed content, so one Arrow step parses each text once."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from lodestone.functions.batches import pieces

#: Articles that a task parses before it passes on their paragraphs, and bytes of their XML.
ARTICLES, ARTICLE_BYTES = 256, 1 << 20

# Elements and section types whose content is no evidence.
SKIPPED_TAGS = {"abstract", "app", "app-group", "article-meta", "back", "bio", "fn-group", "front", "journal-meta", "ref", "ref-list", "table-wrap-foot"}
SKIPPED_SECTIONS = {"abbreviations", "acknowledgements", "acknowledgments", "author-contributions", "competing-interests", "conflict", "conflict-of-interest", "data-availability", "ethics", "funding", "references", "supplementary-material"}

#: Search fields of sections, by what is in a section's type or, without one, in its title.
SECTION_FIELDS = {
    "intro": "intro|background", "methods": "method|material|experimental", "results": "result|finding", "discuss": "discuss", "concl": "conclu", "case": "case", "suppl": "supplement", "appendix": "appendi", "abbr": "abbreviat",
    "ack_fund": "acknowledg|funding", "auth_con": "contribution", "comp_int": "competing|conflict", "data_availability": "availab", "keyword": "keyword",
}


def _tag(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _squeezed(parts) -> str:
    return " ".join("".join(parts).split())


def _prose(node: ET.Element) -> Iterator[str]:
    """The text under node without tables, but with what follows them."""
    yield node.text or ""
    waiting: list[ET.Element | str] = list(reversed(node))
    while waiting:
        child = waiting.pop()
        if isinstance(child, str):
            yield child
            continue
        waiting.append(child.tail or "")
        if _tag(child) not in ("table", "table-wrap"):
            yield child.text or ""
            waiting += reversed(child)


def _table(node: ET.Element) -> str:
    heads = [_squeezed(x.itertext()) for x in node.iter() if _tag(x) in ("label", "caption")]
    rows = ([_squeezed(cell.itertext()) for cell in row if _tag(cell) in ("td", "th")] for row in node.iter() if _tag(row) == "tr")
    lines = [" | ".join(filter(None, cells)) for cells in rows]
    body = " ; ".join(filter(None, lines))
    return ". ".join(x for x in [*heads, body] if x)


def paragraphs_of(xml: str | None) -> list[tuple[str, str, str]]:
    """(text, section title, section type) of the paragraphs and tables of all bodies, or of the whole if there is none; each text once."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    found: dict[str, tuple[str, str, str]] = {}
    anywhere = all(_tag(x) != "body" for x in root.iter())
    # what still has to be visited: a node, whether it is in a body, its nearest section
    waiting = [(root, anywhere, ("", ""))]
    while waiting:
        node, inside, section = waiting.pop()
        tag = _tag(node)
        kind = node.get("sec-type", "").strip() if tag == "sec" else ""
        if tag in SKIPPED_TAGS or kind.lower() in SKIPPED_SECTIONS or "reference" in kind.lower():
            continue
        inside = inside or tag == "body"
        text = "" if not inside else _squeezed(_prose(node)) if tag == "p" else _table(node) if tag == "table-wrap" else ""
        if text:
            found.setdefault(text, (text, *section))
        if tag == "sec":
            title = next((_squeezed(x.itertext()) for x in node if _tag(x) == "title"), "")
            section = (title, kind)
        waiting += [(child, inside, section) for child in reversed(node)]
    return list(found.values())


def article_paragraphs(articles: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """(doc_id, para_idx, text, section_title, section_type) of articles (id, xml). XML that can't be parsed has no rows."""
    kind = articles.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, ARTICLES, ARTICLE_BYTES)):
            places, rows = [], []
            for i, xml in enumerate(batch.column(1).to_pylist()):
                mine = paragraphs_of(xml)
                places += [i] * len(mine)
                rows += [(k, *row) for k, row in enumerate(mine)]
            columns = [pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), *columns], names=["doc_id", "para_idx", "text", "section_title", "section_type"])

    return articles.select(F.col(id_col), F.col(xml_col)).mapInArrow(run, f"doc_id {kind}, para_idx int, text string, section_title string, section_type string")


def sections_of(xml: str | None) -> dict[str, str]:
    """The text of an article by search field, paragraphs joined by line ends; a section of several kinds counts as each, one of none as `other`."""
    found: dict[str, list[str]] = {}
    for text, title, kind in paragraphs_of(xml):
        name = (kind or title).lower()
        for field in [f for f, pattern in SECTION_FIELDS.items() if re.search(pattern, name)] or ["other"]:
            found.setdefault(field, []).append(text)
    return {field: "\n".join(texts) for field, texts in found.items()}


def with_sections(articles: DataFrame, xml_col: str = "xml") -> DataFrame:
    """articles with sections, a map from search field to text, in place of the XML: what fields like METHODS look at. XML that can't be parsed has none."""
    sections = F.pandas_udf(lambda xmls: xmls.map(sections_of), MapType(StringType(), StringType()))
    return articles.withColumn("sections", sections(F.col(xml_col))).drop(xml_col)


def store_full_texts(full_texts: DataFrame, table: str, buckets: int = 64, **options: str) -> None:
    """Writes full texts (pmcid, xml) as a table in buckets by pmcid, so that with_full_text() shuffles papers only."""
    full_texts.select("pmcid", "xml").write.mode("overwrite").options(**options).bucketBy(buckets, "pmcid").sortBy("pmcid").saveAsTable(table)


def with_full_text(papers: DataFrame, full_texts: DataFrame) -> DataFrame:
    """papers (full_text_id, ...; see records.full_text_id) with xml of full_texts (pmcid, xml), null where there is none or none may be fetched."""
    asked = F.nullif(F.col("full_text_id"), F.lit(""))
    return papers.join(full_texts.select("pmcid", "xml").withColumnRenamed("pmcid", "__pmcid").hint("merge"), asked == F.col("__pmcid"), "left").drop("__pmcid")
