"""Fields of form-like texts: by the schema of a document's type, by 'Label: value' lines, and for the graph and the locker."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.needs import Page

DATE = r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})"
NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})"
LONG_NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
MAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
#: The patterns of each field, the first that hits counts; any case, ^ and $ at line ends.
PATTERNS: dict[str, tuple[str, ...]] = {
    "full_name": (
        rf"(?:full\s+)?name\s*[:=-]\s*{NAME}(?:\s+(?:ID|id|S/O|D/O|Age|DOB|Date|Address|Gender|[0-9])|\s*$)",
        rf"(?:holder|bearer|applicant)\s+name\s*[:=-]\s*{NAME}(?:\s+\S|\s*$)",
        rf"(?:Mr|Ms|Mrs|Dr|Shri|Smt)\.?\s+{NAME}",
    ),
    "holder_name": (rf"(?:full\s+)?name\s*[:=-]\s*{NAME}(?:\s+\S|\s*$)", rf"holder\s*[:=-]\s*{NAME}"),
    "applicant_name": (rf"(?:applicant\s+)?name\s*[:=-]?\s*{NAME}(?:\s+(?:ID|Date|DOB|Address|Age|[0-9])|\s*$)", rf"(?:Mr|Ms|Mrs|Dr)\.?\s+{NAME}"),
    "document_number": (
        r"(?:id|identification|document)\s+(?:no|number|#)\s*[:=-]\s*([A-Z0-9-]{4,20})",
        r"(?:card|cert(?:ificate)?)\s+(?:no|number)\s*[:=-]\s*([A-Z0-9/-]{4,20})",
        r"(?:serial|sl)\s*(?:no|number)?\s*[:=-]\s*([A-Z0-9-]{4,20})",
        r"\b([A-Z]{2,4}[-]?[0-9]{4,12}(?:[-][A-Z0-9]+)?)\b",
    ),
    "id_number": (r"(?:id|identification)\s+(?:no|number|#)\s*[:=-]\s*([A-Z0-9-]{4,20})", r"\b(ID[-]?[0-9]{4}[-][0-9]{4}[-][0-9]{4})\b", r"\b([A-Z]{2,4}[-][0-9]{4,12})\b"),
    "certificate_number": (r"cert(?:ificate)?\s+(?:no|number)\s*[:=-]\s*([A-Z0-9/-]{4,20})", r"\b([A-Z]{2,}[0-9]{6,})\b"),
    "application_number": (r"application\s+(?:no|number|#|num)\s*[:=-]?\s*([A-Z0-9/-]+)", r"reference\s+(?:no|number)\s*[:=-]?\s*([A-Z0-9/-]+)", r"\b([A-Z]{2,}[0-9]{4,})\b"),
    "date_of_birth": (rf"date\s+of\s+birth\s*[:=-]\s*{DATE}", rf"\bdob\b\s*[:=-]\s*{DATE}", rf"born\s+on\s*[:=-]?\s*{DATE}", rf"birth\s+date\s*[:=-]\s*{DATE}"),
    "issue_date": (rf"issue\s+date\s*[:=-]\s*{DATE}", rf"issued\s+(?:on|date)\s*[:=-]?\s*{DATE}", rf"date\s+of\s+issue\s*[:=-]\s*{DATE}", rf"valid\s+from\s*[:=-]\s*{DATE}"),
    "expiry_date": (rf"(?:expiry|expiration|valid\s+until|valid\s+upto|valid\s+till)\s*[:=-]\s*{DATE}", rf"expires?\s+(?:on)?\s*[:=-]?\s*{DATE}"),
    "date_filed": (rf"(?:application|filed|submission)\s+date\s*[:=-]\s*{DATE}", rf"date\s+(?:filed|submitted)\s*[:=-]\s*{DATE}", r"\b([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})\b"),
    "address": (r"address\s*[:=-]\s*(.{10,80}?)(?=\s*(?:gender|phone|contact|mobile|dob|date|issue|valid|email|$))", r"residential\s+address\s*[:=-]\s*(.{10,60}?)(?=\s*(?:gender|phone|contact|$))"),
    "applicant_address": (r"(?:applicant\s+)?address\s*[:=-]\s*(.{10,80}?)(?=\s*(?:gender|phone|contact|mobile|dob|date|issue|valid|$))", r"([0-9]+\s+[A-Za-z\s]+(?:nagar|colony|street|road|lane|avenue)\s*,\s*[A-Za-z\s,]+[0-9]{6})"),
    "gender": (r"gender\s*[:=-]\s*(male|female|other|transgender)", r"\b(male|female)\b(?!\s*(?:ward|patient|doctor))"),
    "nationality": (r"nationality\s*[:=-]\s*([A-Za-z]+)", r"citizenship\s*[:=-]\s*([A-Za-z]+)"),
    "father_name": (rf"father'?s?\s+name\s*[:=-]\s*{LONG_NAME}", rf"s/o\.?\s*{LONG_NAME}"),
    "mother_name": (rf"mother'?s?\s+name\s*[:=-]\s*{LONG_NAME}", rf"d/o\.?\s*{LONG_NAME}"),
    "contact_number": (r"(?:phone|contact|mobile|tel|mo?b?\.?)\s*(?:no|number)?\s*[:=-]\s*([+]?[0-9()\s-]{10,})", r"\b(\+?91[\s-]?[0-9]{10})\b", r"\b([0-9]{10})\b"),
    "email": (rf"email\s*(?:id|address)?\s*[:=-]\s*{MAIL}", rf"\b{MAIL}\b"),
    "document_type_specific": (r"^([A-Z][A-Z\s]{3,}(?:CARD|CERTIFICATE|LICENCE|LICENSE|PERMIT|PASS))$", r"(?:type|category)\s*[:=-]\s*([A-Za-z\s]+?)(?:\n|$)"),
    "purpose": (r"purpose\s*[:=-]\s*([^\n]+?)(?:\s+[A-Z][a-z]+\s*[:=-]|$)", r"reason\s*[:=-]\s*([^\n]+?)(?:\s+[A-Z][a-z]+\s*[:=-]|$)"),
    "department": (r"department\s*[:=-]\s*([^\n]+?)(?:\s+[A-Z]|$)", r"dept\.?\s*[:=-]\s*([^\n]+?)(?:\s+[A-Z]|$)"),
    "document_title": (r"^([A-Z\s]{5,}(?:FORM|APPLICATION|CERTIFICATE|LICENSE|PERMIT|CARD))$",),
    "date": (r"(?:^|\s)date\s*[:=-]\s*([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4})", r"\b([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})\b", r"\b([0-9]{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{4})\b"),
    "issuing_authority": (
        r"issu(?:ed|ing)\s+(?:by|authority)\s*[:=-]?\s*([A-Z][A-Za-z0-9\s&,.-]{3,60}?)(?:\n|\.|$)",
        r"authority\s*[:=-]\s*([A-Z][A-Za-z0-9\s&,.-]{3,60}?)(?:\n|\.|$)",
        r"(?:this is to certify|certified)\s+.{0,80}?\bby\s+(?:the\s+)?([A-Z][A-Za-z0-9\s&,.-]{3,60}?)(?:\n|\.|$)",
        r"\b([A-Z][A-Za-z\s&]+(?:Ltd|Limited|Pvt|Corporation|Corp|Inc|LLP|Authority|Board|Council|Department|Ministry|University|Ins\w*tute|Commission)\.?)\b",
    ),
    "author": (r"(?:author|prepared|written)\s+by\s*[:=-]?\s*([A-Z][A-Za-z.\s]{2,40}?)(?:\n|\.|$)", r"issu(?:ed|ing)\s+(?:by|authority)\s*[:=-]?\s*([A-Z][A-Za-z0-9\s&,.-]{3,60}?)(?:\n|\.|$)", r"signed\s+by\s*[:=-]?\s*([A-Z][A-Za-z.\s]{2,40}?)(?:\n|\.|$)"),
    "reference_number": (
        r"(?:reference|ref|regd?|registration|certificate|cert|serial|sl|enrolment|enrollment|file|memo)\s*\.?\s*(?:no|number|#)\s*[:=-]?\s*([A-Z0-9][A-Z0-9/-]{3,24})",
        r"\b([A-Z]{2,6}[/-]?[0-9]{4,}[/-]?[A-Z0-9]*)\b",
    ),
}
#: What a text may hold without a schema, and the pattern of 'Label: value' lines.
UNIVERSAL: dict[str, str] = {
    "date": r"\b([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})\b",
    "email": rf"\b{MAIL}\b",
    "phone": r"\b(\+?(?:91[\s-]?)?[0-9]{10})\b",
    "pan_number": r"\b([A-Z]{5}[0-9]{4}[A-Z])\b",
    "aadhaar_number": r"\b([0-9]{4}\s[0-9]{4}\s[0-9]{4})\b",
    "pincode": r"\b([0-9]{6})\b",
    "amount": r"(?:rs\.?|inr|₹)\s*([0-9,]+(?:\.[0-9]{2})?)",
    "case_number": r"(?:case|file|matter)\s*(?:no|number|#)\s*[:-]?\s*([A-Z0-9/-]{4,20})",
    "court": r"(?:in\s+the\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Court|Tribunal|Commission|Board))",
    "organization": r"\b([A-Z][A-Za-z\s&]+(?:Ltd|Limited|Pvt|Corporation|Corp|Inc|LLP|Authority|Board|Council)\.?)\b",
}
LABEL_LINE = r"(?m)^([A-Za-z][A-Za-z0-9 _/]{1,40}?)\s*[:-]\s*(.{2,120}?)(?:\s*$)"
NOISE = ("the", "and", "or", "of", "to", "in", "a", "an", "is", "it", "this", "that", "for", "on", "at", "by", "with", "from")
#: What the locker and the graph look for.
LOCKER = {"dates": (r"\b([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4})\b", 5), "references": (r"\b([A-Z]{1,3}[\s-]?[0-9]{4,12})\b", 5), "amounts": (r"(?:Rs\.?|₹|INR)\s*([0-9,]+(?:\.[0-9]{2})?)", 3), "names": (r"(?:Name|name)\s*[:-]\s*([A-Z][a-zA-Z\s.]{2,40})", 3)}
GRAPH = {
    "full_name": ("Person", rf"Name\s*[:-]\s*{NAME}(?=\s+(?:ID|id|S/O|Age|DOB|Date|Address|Gender|[0-9])|\s*$)"),
    "date_of_birth": ("Date", r"Date\s+of\s+Birth\s*[:-]\s*([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})"),
    "issue_date": ("Date", r"Issue\s+Date\s*[:-]\s*([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})"),
    "expiry_date": ("Date", r"Valid\s+Until\s*[:-]\s*([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})"),
    "document_number": ("Identifier", r"ID\s+Number\s*[:-]\s*([A-Z0-9-]{4,20})"),
    "address": ("Location", r"Address\s*[:-]\s*(.{10,80}?)(?=\s*(?:Gender|Phone|Date|Issue|Valid|$))"),
    "gender": ("Attribute", r"Gender\s*[:-]\s*(Male|Female|Other)"),
}
#: Patterns that try a long run of characters from each of its words: marked by a part of theirs, with the characters of a run and what a run
#: must hold. Only such runs are searched, so that long texts take linear time.
RUNS = (
    ("(?:Ltd|Limited", r"[A-Za-z\s&]+", r"(?:Ltd|Limited|Pvt|Corporation|Corp|Inc|LLP|Authority|Board|Council|Department|Ministry|University|Ins\w*tute|Commission)\b"),
    ("(?:Court|Tribunal", r"[A-Za-z\s]+", r"\s(?:Court|Tribunal|Commission|Board)"),
    ("(?:nagar|colony", r"[A-Za-z0-9\s,]+", r"(?:nagar|colony|street|road|lane|avenue)\s*,"),
    (MAIL, r"[A-Za-z0-9._%+@-]+", "@"),
)


def cleaned(value: str) -> str:
    """A hit with its spaces squeezed, without commas and points at its end."""
    return re.sub("[,.]+$", "", re.sub(r"\s+", " ", value.strip(" "), flags=re.ASCII).strip(" ")).strip(" ")


@functools.cache
def finder(pattern: str, flags: int = re.IGNORECASE | re.MULTILINE) -> Callable[[str], str]:
    """The function that gives the first hit of a pattern's first group in a text, in any case, '' without one."""
    whole = re.compile(pattern, flags | re.ASCII)
    first = lambda m: (m[1] or "") if m else ""
    kind = next((r for r in RUNS if r[0] in pattern), None)
    if kind is None or (kind[0] == MAIL and not pattern.startswith(r"\b")):
        return lambda text: first(whole.search(text))
    run, needed = re.compile(kind[1], re.ASCII), re.compile(kind[2], flags | re.ASCII)

    def found(text: str) -> str:
        at = 0
        while (need := needed.search(text, at)) is not None:
            # the run around what is needed: its start is looked for backwards, piece by piece
            low = need.start()
            while low > at:
                piece = max(at, low - 512)
                tail = re.search(f"(?:{kind[1]})$", text[piece:low], re.ASCII)
                if tail is None:
                    break
                low = piece + tail.start()
                if tail.start():
                    break
            high = (m := run.match(text, need.start())) and m.end() or need.end()
            hit = whole.search(text, low, min(len(text), max(high, need.end()) + 2))
            if hit:
                return hit[1] or ""
            at = max(high, need.end())
        return ""

    return found


def first_hit(page: Page, patterns: tuple[str, ...]) -> str | None:
    """The cleaned hit of the first pattern that has one of two characters or more; None where none has."""
    for p in patterns:
        if page.may_hit(p) and len(value := cleaned(finder(p)(page.text))) > 1:
            return value
    return None


def _labelled(page: Page, title_: str | None) -> list[tuple[str, str]]:
    """(field, value) without a schema."""
    lines = {}
    for k, v in re.findall(LABEL_LINE, page.text, re.ASCII):
        field = re.sub("[^a-z0-9_]", "", re.sub(r"[\s/]+", "_", k.strip(" ").lower(), flags=re.ASCII))
        value = re.sub("[.,;]+$", "", v.strip(" "))
        if field and len(value) >= 2:
            lines.pop(field, None)
            lines[field] = value
    rest = [(name, finder(p, re.IGNORECASE)(page.text).strip(" ")) for name, p in UNIVERSAL.items() if name not in lines and page.may_hit(p)]
    if "document_title" not in lines:
        rest.append(("document_title", title_ or ""))
    return [(k, v) for k, v in [*lines.items(), *rest] if k not in NOISE and len(k) > 1 and len(v) > 1]


def _extracted(docs: DataFrame, rules: dict[str, list] | None, labels: bool, patterns: dict, most: int | None) -> DataFrame:
    """doc_id, own, field, value, type, required of each document, found in its own row: texts neither move nor repeat."""
    slim = docs.select("doc_id", F.col("document_type") if rules is not None else F.lit("").alias("document_type"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.withColumn("text", F.substring("text", 1, most)) if most else slim
    slim = slim.withColumn("title_", title(F.col("text")))
    item = "array<struct<own: boolean, field: string, value: string, type: string, required: boolean>>"

    def read(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("own", pa.bool_()), ("field", pa.string()), ("value", pa.string()), ("type", pa.string()), ("required", pa.bool_())]))
        for batch in batches:
            out = []
            for of, text, title_ in zip(*(batch.column(c).to_pylist() for c in ("document_type", "text", "title_")), strict=True):
                page = Page(text)
                rows = [(True, field, first_hit(page, patterns.get(field, ())), type_, required) for field, type_, required in (rules or {}).get(of, ())]
                known = {r[1] for r in rows if r[2] is not None}
                if labels:
                    rows += [(False, k, v, None, False) for k, v in _labelled(page, title_) if k not in known]
                out.append([dict(zip(("own", "field", "value", "type", "required"), r, strict=True)) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "fields"])

    return slim.mapInArrow(read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fields {item}").select("doc_id", F.inline("fields"))


def _rules(schemas: DataFrame, most: int) -> dict[str, list]:
    """The rows of schemas by document type; most rows at most."""
    held = schemas.select("document_type", "field", "type", "required").limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rows of schemas")
    out: dict[str, list] = {}
    for r in held:
        out.setdefault(r.document_type, []).append((r.field, r.type, r.required))
    return out


def schema_fields(docs: DataFrame, schemas: DataFrame, patterns: dict[str, tuple[str, ...]] | None = None, most_rules: int = 10_000, most: int | None = None) -> DataFrame:
    """doc_id, field, value, confidence, type, required: a row for each field that schemas(document_type, field, type, required; most_rules at most)
    names for a document's type; .9 for a hit, 0 and a null value without one. Whole texts are read, or the first most characters.

    Only the patterns of the fields at hand are run.
    """
    found = _extracted(docs, _rules(schemas, most_rules), False, PATTERNS if patterns is None else patterns, most)
    return found.select("doc_id", "field", "value", F.when(F.col("value").isNotNull(), 0.9).otherwise(0.0).alias("confidence"), "type", "required")


def title(text) -> Column:
    """The first of eight lines that looks like a heading: 5 to 90 characters, no ':' or '=', four letters or more, most of them
    capitals or each word with one; null where none does."""
    lines = F.transform(F.slice(F.split(text, "\r\n|\r|\n", 9), 1, 8), lambda x: F.regexp_replace(x, r"^[ \t.:-]+|[ \t.:-]+$", ""))
    letters = lambda x: F.regexp_replace(x, "[^A-Za-z]", "")
    capitals = lambda x: F.try_divide(F.length(F.regexp_replace(x, "[^A-Z]", "")), F.length(letters(x))) > 0.6
    titled = lambda x: ~x.rlike("(^|[^A-Za-z])[a-z]") & ~x.rlike("[A-Za-z][A-Z]")
    good = lambda x: F.length(x).between(5, 90) & ~x.rlike("[:=]") & (F.length(letters(x)) >= 4) & (capitals(x) | titled(x))
    return F.try_element_at(F.filter(lines, good), F.lit(1))


def label_fields(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, field, value without a schema: 'Label: value' lines (the last of a label counts; labels in snake case), then the
    UNIVERSAL patterns and a title for names that no line has. Values have two characters or more. Whole texts are read, or the first most
    characters."""
    return _extracted(docs, None, True, {}, most).select("doc_id", "field", "value")


def extracted_fields(docs: DataFrame, schemas: DataFrame, most_rules: int = 10_000, most: int | None = None) -> DataFrame:
    """doc_id, field, value, confidence, type, required: the schema's fields, and those of label_fields that it didn't find
    (.85, with a guessed type, not required)."""
    found = _extracted(docs, _rules(schemas, most_rules), True, PATTERNS, most)
    sure = F.when(~F.col("own"), 0.85).when(F.col("value").isNotNull(), 0.9).otherwise(0.0)
    return found.select("doc_id", "field", "value", sure.alias("confidence"), F.when(F.col("own"), F.col("type")).otherwise(T.field_type(F.col("field"))).alias("type"), "required")


def locker_metadata(text) -> Column:
    """A struct of joined dates, references, amounts and names, the first few of each."""
    hits = lambda p, n: F.array_join(F.slice(F.transform(T.found(F.trim(text), p, 1), lambda x: F.trim(x)), 1, n), ";")
    return F.struct(*[hits(p, n).alias(name) for name, (p, n) in LOCKER.items()])


def graph_fields(docs: DataFrame) -> DataFrame:
    """doc_id, field, type, value: fields that the graph builder reads, as vertices of a type."""
    t = F.coalesce("text", F.lit(""))
    hits = F.array(*[F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"), F.trim(F.regexp_extract(t, f"(?im){p}", 1)).alias("value")) for name, (kind, p) in GRAPH.items()])
    return docs.select("doc_id", F.inline(F.filter(hits, lambda h: F.length(h["value"]) > 1)))


def parsed_reply(reply, field) -> Column:
    """value and confidence that a model's reply has for a field: the first { to the last } read as JSON; an object of value and
    confidence, or a bare value (.7); null and 0 without it."""
    read = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "map<string,string>")
    given = F.try_element_at(read, field)
    inner = F.from_json(given, "value string, confidence double")
    return F.struct(
        F.when(given.startswith("{"), inner["value"]).otherwise(given).alias("value"),
        F.when(given.startswith("{"), F.coalesce(inner["confidence"], F.lit(0.0))).when(given.isNotNull(), 0.7).otherwise(0.0).alias("confidence"),
    )
