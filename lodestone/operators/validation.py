"""Checks of fielded queries in a column: parsed once, then each clause is checked by column rules.

A clause is FIELD:value, where value is quoted, a range in brackets, a group in parentheses, or bare up to
the next operator or bracket; clauses inside a group count as well. What is wrong with operators, groups and operands comes from parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.records import day_key, is_day, is_isbn, license_code, role_name
from lodestone.operators.parsing import check_column

# Fields and the values they take.
FIELDS = """ABSTRACT ACCESSION_ID ACCESSION_TYPE ACK_FUND AFF ANNOTATION_TYPE APPENDIX ARXPR_PUBS AUTH AUTHORID AUTHORID_TYPE
AUTHOR_ROLES AUTH_COLLECTIVE_LIST AUTH_CON AUTH_FIRST AUTH_LAST AUTH_MAN AUTH_MAN_ID BODY BOOK_ID CASE CITED CITES CHEBI_PUBS
CHEBITERM CHEM COMP_INT CONCL CREATION_DATE DATA_AVAILABILITY DISEASE DISCUSS DOI ED EMBARGO_DATE EMBARGOED_MAN EMBL_PUBS
EPMC_AUTH_MAN ESSN EXT_ID E_PDATE FIG FIRST_IDATE FIRST_PDATE GENE_PROTEIN GOTERM GRANT_AGENCY GRANT_ID HAS_ABSTRACT HAS_ARXPR
HAS_BOOK HAS_CHEBI HAS_CHEMBL HAS_DATA HAS_DOI HAS_EMBL HAS_FREE_FULLTEXT HAS_FT HAS_INTACT HAS_INTERPRO HAS_LABSLINKS HAS_OMIM
HAS_PDB HAS_PDF HAS_PREPRINT HAS_PUBLISHED_VERSION HAS_REFLIST HAS_SUPPL HAS_TM HAS_UNIPROT HAS_VERSION_EVALUATIONS HAS_XREFS
IN_EPMC IN_PMC INTRO INTACT_PUBS INTERPRO_PUBS INVESTIGATOR ISBN ISSN ISSUE JOURNAL KEYWORD KW LABS_PUBS LANG LICENSE METHODS
MESH NIH_AUTH_MAN OPEN_ACCESS ORGANISM ORG_ID OTHER PDB_PUBS PMCID PUBLISHER PUB_TYPE PUB_YEAR P_PDATE REFFED_BY REF RESULTS SRC
SUPPL TABLE TITLE TITLE_ABS UNIPROT_PUBS UPDATE_DATE VOLUME""".split()
FLAG_FIELDS = [f for f in FIELDS if f.startswith("HAS_")] + ["OPEN_ACCESS", "EPMC_AUTH_MAN", "NIH_AUTH_MAN", "AUTH_MAN", "EMBARGOED_MAN", "IN_PMC", "IN_EPMC"]
DATE_FIELDS = ["PUB_YEAR", "E_PDATE", "P_PDATE", "UPDATE_DATE", "CREATION_DATE", "FIRST_PDATE", "FIRST_IDATE", "EMBARGO_DATE"]
SOURCES = "MED PMC AGR ETH PPR CTX NBK CBA HIR PAT".split()
ACCESSION_TYPES = """alphafold arrayexpress bia biomodels bioproject biosample biosamples biostudies brenda cath cellosaurus chebi chembl
complexportal dbgap doi ebisc ega efo emdb empiar ensembl eudract eva gca gen geo gisaid go hgnc hipsci hpa igsr intact interpro
metabolights mint nct omim orphadata pdb pfam pxd reactome refseq refsnp rfam rhea rnacentral rrid treefam uniprot""".split()
ANNOTATION_TYPES = ["Chemicals", "Diseases", "Experimental Methods", "Gene Disease Relationship", "Gene Ontology", "Gene_Proteins", "Organisms", "Body-Site", "Date", "Ecoregion", "Engineered", "Gene", "Host", "Kit", "LCM", "LS", "Place", "Primer", "Sample-Material", "Sequencing", "Site", "State", "Treatment"]
AUTHOR_ROLES = ["Conceptualization", "Data curation", "Formal analysis", "Funding acquisition", "Investigation", "Methodology", "Project administration", "Resources", "Software", "Supervision", "Validation", "Visualization", "Writing - original draft", "Writing - review & editing"]
LANGUAGES = """Afrikaans,Albanian,Arabic,Armenian,Azeri,Bosnian,Bulgarian,Catalan,Chinese,Czech,Danish,Dutch,English,Esperanto,Estonian,Finnish,
French,Gaelic,Georgian,German,Greek,Hebrew,Hindi,Hungarian,Icelandic,Indonesian,Italian,Japanese,Kinyarwanda,Korean,Latin,Latvian,Lithuanian,
Macedonian,Malay,Malayalam,Maori,Norwegian,Persian,Polish,Portuguese,Pushto,Romanian,Russian,Serbo-Croatian,Serbo-Croatian (Cyrillic),
Serbo-Croatian (Roman),Slovak,Slovenian,Spanish,Swedish,Thai,Turkish,Ukrainian,Ukranian,Vietnamese""".replace("\n", "").split(",")
LANGUAGE_CODES = ["eng", "fre", "ukr"]
LICENSES = "CC CC0 CC-BY CC-BY-SA CC-BY-ND CC-BY-NC CC-BY-NC-ND CC-BY-NC-SA".split()
ONE_VALUE = ["PMCID", "ISSN", "ESSN", "ISBN", "DOI"]
NO_WILDCARD = ["AUTHORID", "CITES", "REFFED_BY", "ISSN", "ESSN", "ISBN", "DOI", "BOOK_ID", "AUTH_MAN_ID"]
NO_BARE_WILDCARD = ["GENE_PROTEIN", "DISEASE", "ORGANISM", "CHEBITERM", "GOTERM", "CHEM", "MESH"]
FORMATS = {"AUTHORID": r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$", "PMCID": r"(?i)^PMC\d+$", "ISSN": r"(?i)^\d{4}-\d{3}[\dX]$", "ESSN": r"(?i)^\d{4}-\d{3}[\dX]$", "DOI": r"(?i)^10\.\d{4,9}/\S+$", "BOOK_ID": r"(?i)^NBK\d+$", "AUTH_MAN_ID": r"^[A-Za-z]{2,}[A-Za-z0-9._-]*\d+[A-Za-z0-9._-]*$"}
#: Fields that are of use only beside others.
COMPANIONS = {"GRANT_ID": ["GRANT_AGENCY"], "EXT_ID": ["SRC"], "INVESTIGATOR": ["AUTH_COLLECTIVE_LIST"], "ISSUE": ["JOURNAL", "VOLUME"]}

CITATION, BARE_WILDCARD = r"^[A-Za-z0-9.-]+_([A-Za-z]+)$", r"^[*?]+$"

#: What a clause's checks read: of the clauses of a query, its place, and the value without its quotes.
CLAUSE = ["pos", "raw", "field", "before", "behind", "value", "kind", "bare"]


def _clauses(parsed: DataFrame) -> DataFrame:
    """parsed (p: see check_column) with a row a clause, or one with a null pos where a query has none."""
    columns = [c for c in parsed.columns]
    rows = parsed.select("*", F.posexplode_outer("p.clauses").alias("pos", "part")).select(*columns, "pos", "part.raw", F.upper("part.raw").alias("field"), "part.before", "part.behind", "part.value", "part.kind")
    rows = rows.withColumn("kind", F.when(F.trim("value") == "", "missing").otherwise(F.col("kind")))
    first = F.substring("value", 1, 1)
    closed = (F.length("value") > 1) & (F.substring("value", -1, 1) == first)
    bare = F.when(F.col("kind").isin("quoted", "single_quoted") & closed, F.expr("trim(substring(value, 2, length(value) - 2))")).otherwise(F.trim("value"))
    return rows.withColumn("bare", bare)


def clauses(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """queries with pos, raw, field, before, behind, value, kind and bare (the value without its quotes): one row a clause."""
    rows = _clauses(queries.withColumn("p", check_column(F.col(query_col))))
    return rows.where("pos is not null").select(*queries.columns, *CLAUSE)


def _date_messages(field: Column, bare: Column, kind: Column) -> list[tuple[Column, Column]]:
    ends = F.split(F.trim(F.expr("substring(bare, 2, length(bare) - 2)")), r"(?i)\s+TO\s+", -1)
    lo, hi = F.trim(F.get(ends, F.lit(0))), F.trim(F.get(ends, F.lit(1)))
    fits = lambda c: (c == "*") | c.rlike(r"^\d{4}$") | ((field != "PUB_YEAR") & is_day(c))
    single, ranged = kind != "range", (kind == "range") & (F.size(ends) == 2)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    whole = F.when(field == "PUB_YEAR", bare.rlike(r"^\d{4}$")).otherwise(bare.rlike(r"^\d{4}$") | is_day(bare))
    expected = F.when(field == "PUB_YEAR", "YYYY").otherwise("YYYY or YYYY-MM-DD")
    return [
        (single & ~whole, say("Invalid value for ", field, ": '", bare, "' - expected ", expected)),
        ((kind == "range") & (F.size(ends) != 2), say("Invalid range for ", field, ": '", bare, "' - use [start TO end]")),
        (ranged & ~fits(lo), say("Invalid range start for ", field, ": '", lo, "'")),
        (ranged & ~fits(hi), say("Invalid range end for ", field, ": '", hi, "'")),
        (ranged & (lo != "*") & (hi != "*") & (day_key(lo) > day_key(hi)), say("Invalid range for ", field, ": start '", lo, "' is after end '", hi, "'")),
    ]


def clause_messages(rows: DataFrame) -> DataFrame:
    """rows of clauses() with messages, an array of what is wrong, in the order of the rules."""
    field, raw, bare, kind, value = (F.col(c) for c in ("field", "raw", "bare", "kind", "value"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    known = field.isin(FIELDS)
    inner = F.expr("trim(substring(value, 2, length(value) - 2))")
    missing = (kind == "missing") | (kind.isin("range", "parenthesized") & (inner == ""))
    source = F.upper(F.regexp_extract(bare, CITATION, 1))
    several = field.isin(ONE_VALUE) & bare.contains(",")
    invalid = say("Invalid value for ", field, ": '", bare, "'")
    shape = F.lit(False)
    for name, pattern in FORMATS.items():
        shape = shape | ((field == name) & ~bare.rlike(pattern))
    shape = shape | ((field == "ISBN") & ~is_isbn(bare))
    wild, quoted, dated = bare.rlike(r"[*?]"), kind.isin("quoted", "single_quoted"), field.isin(DATE_FIELDS)
    checks = [
        (~known, say("Invalid field tag '", raw, "'")),
        ((F.col("before") != "") & (kind != "missing"), say("Field tag '", raw, "' has invalid spacing before colon")),
        ((F.col("behind") != "") & (kind != "missing"), say("Field tag '", raw, "' has invalid spacing after colon")),
        (known & missing, say("Field tag '", raw, "' is missing a value")),
    ]
    usable = known & ~missing
    rules = [
        ((kind == "bare") & bare.rlike(r"\s"), say("Invalid syntax: ", raw, ":", F.trim(value), " - multi-word field values must use quotes or parentheses")),
        (field.isin(FLAG_FIELDS) & ~F.upper(bare).isin("Y", "N"), say(invalid, " - must use Y or N")),
        ((field == "SRC") & ~F.upper(bare).isin(SOURCES), say("Invalid value for SRC: '", F.upper(bare), "'")),
        ((field == "ACCESSION_TYPE") & ~F.lower(bare).isin(ACCESSION_TYPES), say("Invalid value for ACCESSION_TYPE: '", F.lower(bare), "'")),
        ((field == "ANNOTATION_TYPE") & ~bare.isin(ANNOTATION_TYPES), invalid),
        ((field == "AUTHORID_TYPE") & (F.upper(bare) != "ORCID"), say("Invalid value for AUTHORID_TYPE: '", F.upper(bare), "'")),
        ((field == "AUTHOR_ROLES") & ~role_name(bare).isin([r.lower() for r in AUTHOR_ROLES]), invalid),
        ((field == "LANG") & ~F.lower(bare).isin([x.lower() for x in [*LANGUAGES, *LANGUAGE_CODES]]), invalid),
        ((field == "LICENSE") & ~license_code(bare).isin(LICENSES), invalid),
        *((dated & c, m) for c, m in _date_messages(field, bare, kind)),
        (several, say("Multiple comma-separated values are not allowed for field '", field, "'")),
        (field.isin("CITES", "REFFED_BY") & (source == ""), say("Invalid ", field, " format: '", bare, "' - expected identifier_source")),
        (field.isin("CITES", "REFFED_BY") & (source != "") & ~source.isin(SOURCES), say("Invalid source suffix in ", field, ": '", bare, "'")),
        (~several & shape, say("Invalid ", field, " format: '", bare, "'")),
        (wild & quoted, say("Wildcards are not allowed inside quotes for field '", field, "'")),
        (wild & ~quoted & field.isin(NO_WILDCARD), say("Wildcards are not allowed for field '", field, "'")),
        (dated & ~quoted & bare.contains("?"), say("Question-mark wildcards are not allowed for field '", field, "'")),
        (dated & ~quoted & bare.contains("*") & ~bare.contains("?") & (kind != "range"), say("Wildcards are only allowed in date ranges for field '", field, "'")),
        (field.isin(NO_BARE_WILDCARD) & ~quoted & bare.rlike(BARE_WILDCARD), say("Wildcard-only presence checks are not allowed for field '", field, "' - use ANNOTATION_TYPE or HAS_TM when you mean annotation presence")),
    ]
    made = F.array(*(F.when(c, m) for c, m in [*checks, *((usable & c, m) for c, m in rules)]))
    return rows.withColumn("messages", F.filter(made, lambda m: m.isNotNull()))


def validate(queries: DataFrame, id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """(id, query, valid, reasons, warnings): all that is wrong with each query: its structure, its quotes, its clauses in order, each message once.

    Ids are unique. A null query is an empty one. Each text is parsed once, and its clauses meet again by id.
    """
    read = queries.select(F.col(id_col), F.col(query_col)).withColumn("p", check_column(F.col(query_col)))
    checked = clause_messages(_clauses(read))
    nothing = F.array().cast("array<string>")
    whole = lambda c: F.first(F.col(f"p.{c}")).alias(c)
    one = F.struct(F.col("pos"), F.when(F.col("pos").isNotNull(), F.col("messages")).otherwise(nothing).alias("messages"))
    found = checked.groupBy(id_col).agg(F.first(query_col).alias(query_col), whole("faults"), whole("quote_faults"), whole("has_root"), F.array_sort(F.collect_list(one)).alias("listed"), F.collect_set("field").alias("present"))
    aimless = F.when(~F.col("has_root"), F.array(F.lit("Query does not contain any searchable terms"))).otherwise(nothing)
    said = F.concat("faults", "quote_faults", F.flatten(F.transform("listed", lambda x: x["messages"])), aimless)
    reasons = F.when(F.trim(F.coalesce(F.col(query_col), F.lit(""))) == "", F.array(F.lit("Query is empty or None"))).otherwise(F.array_distinct(said))
    hints = [F.when(F.array_contains("present", field) & ~F.forall(F.array(*map(F.lit, others)), lambda o: F.array_contains("present", o)), f"{field} is usually used together with {' and '.join(others)}") for field, others in COMPANIONS.items()]
    out = found.select(id_col, query_col, reasons.alias("reasons"), F.filter(F.array(*hints), lambda m: m.isNotNull()).alias("warnings"))
    return out.withColumn("valid", F.size("reasons") == 0)


def usable(validated: DataFrame, group: str) -> DataFrame:
    """The valid queries of each group; all of them where none is valid."""
    best = validated.groupBy(group).agg(F.max("valid").alias("any_valid"))
    return validated.join(best, group).where("valid or not any_valid").drop("any_valid")


def summary(validated: DataFrame) -> DataFrame:
    """One row: overall_status, total, passed and failed. No queries at all fail."""
    counts = validated.agg(F.count("*").alias("total"), F.count_if("valid").alias("passed"))
    return counts.select(F.when((F.col("total") > 0) & (F.col("passed") == F.col("total")), "pass").otherwise("fail").alias("overall_status"), "total", "passed", (F.col("total") - F.col("passed")).alias("failed"))
