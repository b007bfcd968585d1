"""Verification of documents by rules: a row per step, the department whose registry is asked, fraud score and badge."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.needs import Page

DAY = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}"
# fixed values: words and patterns of the general steps
MARKERS = ("government of india", "भारत सरकार", "republic of india", "state government", "hereby certif", "authorized signatory", "official seal", "emblem", "notarized")
SIGNATURES = ("signature", "signed", "sd/-", "authorised")
AUTHORITIES = ("collector", "commissioner", "tehsildar", "registrar", "superintendent", "director", "secretary", "minister", "magistrate", "judge", "inspector", "officer", "authority", "department", "government", "controller")
CASES = ("case no", "case number", "writ petition", "civil suit", "criminal case", "fir no", "complaint no", "appeal", "stay order", "injunction", "pending")
SERIAL = r"(?i)\b(?:serial|sr|sl|no|ref|number)\s*[:.-]?\s*([A-Z0-9]{4,20})\b"
# fixed values: department of a document type, and words that name one where the type doesn't, in order
DEPARTMENTS = {
    "passport": "passport_office", "driving_licence": "rto", "driving licence": "rto", "birth_certificate": "registrar_office", "birth certificate": "registrar_office",
    "income_certificate": "revenue_department", "income certificate": "revenue_department", "land_record": "revenue_department", "land record": "revenue_department",
    "education_certificate": "education_board", "education certificate": "education_board", "fir": "general", "court_order": "general", "court order": "general",
}
WORDS = {
    "passport_office": ("passport", "republic of india", "travel document"),
    "rto": ("driving licence", "motor vehicle", "rto", "transport"),
    "registrar_office": ("birth", "marriage", "registrar", "municipal"),
    "education_board": ("board", "university", "marksheet", "degree"),
    "revenue_department": ("revenue", "land", "survey", "income", "khasra"),
    "stamp_paper": ("stamp paper", "e-stamp", "non-judicial"),
    "driving_school": ("driving school", "certificate"),
}


@dataclass(frozen=True)
class Rule:
    """A registry's check: passed if a pattern or a word is found, else another outcome if a fallback word is, else the last one.

    Outcomes are (status, confidence); without one there is no step. within says that the words of only_if must occur at all.
    """

    name: str
    passed: float
    pattern: str = ""
    words: tuple[str, ...] = ()
    fallback: tuple[str, ...] = ()
    weak: tuple[str, float] | None = None
    rest: tuple[str, float] | None = None
    only_if: tuple[str, ...] = ()


# fixed values: the registries' patterns, words and confidences
REGISTRIES: dict[str, tuple[Rule, ...]] = {
    "driving_school": (
        Rule("Driving School Registration Verification", 0.85, r"(?i)\b(DS[/-]?[0-9]{4,8}[/-]?[0-9]{0,4})\b", rest=("WARNING", 0.3)),
        Rule("Certificate Number Verification", 0.8, r"(?i)\b(CERT[/-]?[0-9]{4,10})\b", fallback=("certificate", "certify", "certified"), weak=("WARNING", 0.5), rest=("SKIPPED", 0.0)),
        Rule("Issuing Authority Verification", 0.75, words=("rto", "transport", "driving school", "motor vehicle", "authority"), rest=("WARNING", 0.2)),
    ),
    "education_board": (
        Rule("Education Certificate Verification", 0.8, words=("marksheet", "certificate", "degree", "diploma", "transcript", "result"), rest=("WARNING", 0.3)),
        Rule("Board Registration Verification", 0.85, words=("cbse", "icse", "isc", "cisce", "state board", "ignou", "ugc", "aicte", "pu", "mu", "du", "board of secondary education", "board of higher secondary"), rest=("WARNING", 0.3)),
        Rule("Student Registration Verification", 0.75, r"(?i)\b(?:roll\s*(?:no|number)?|reg\s*(?:no|number)?)\s*[:-]?\s*(\w{4,20})\b"),
    ),
    "revenue_department": (
        Rule("Land Survey Number Verification", 0.85, r"(?i)\b(?:survey|khasra|gat)\s*(?:no|number)?\s*[:-]?\s*([0-9]{1,6}[/-]?[0-9]{0,6})\b", rest=("WARNING", 0.2)),
        Rule("Land Record Type Verification", 0.8, words=("7/12", "khata", "patta", "mutation", "encumbrance", "revenue", "land", "property")),
        Rule("Land Owner Verification", 0.7, r"(?i)(?:owner|malik|dharak)\s*[:-]?\s*([A-Z][a-zA-Z\s.]{2,40})"),
    ),
    "rto": (
        Rule("Driving Licence Number Verification", 0.9, r"\b([A-Z]{2}[0-9]{2}\s?[0-9]{11})\b", fallback=("driving licence", "driver license", "dl no"), weak=("WARNING", 0.4)),
        Rule("Vehicle Registration Verification", 0.85, r"\b([A-Z]{2}[\s-]?[0-9]{1,2}[\s-]?[A-Z]{1,3}[\s-]?[0-9]{1,4})\b"),
        Rule("Vehicle Class Verification", 0.8, words=("lmv", "hmv", "mcwg", "3w-nt", "trans")),
    ),
    "passport_office": (
        Rule("Passport Number Verification", 0.9, r"\b([A-Z][0-9]{7})\b", fallback=("passport",), weak=("WARNING", 0.3), rest=("SKIPPED", 0.0)),
        Rule("Issuing Country Verification", 0.95, words=("republic of india", "भारत गणराज्य")),
        Rule("MRZ (Machine Readable Zone) Verification", 0.85, r"[A-Z<]{2}[A-Z<]{3}[A-Z<]{39}"),
    ),
    "registrar_office": (
        Rule("Birth Certificate Registration Verification", 0.85, r"(?i)(?:registration\s*(?:no|number)?|reg\.?\s*no)\s*[:-]?\s*(\w{3,20})", rest=("WARNING", 0.5), only_if=("birth", "born", "date of birth", "registration of births")),
        Rule("Marriage Certificate Verification", 0.75, words=("marriage", "married", "spouse", "husband", "wife", "wedding")),
        Rule("Registrar Authority Verification", 0.8, words=("registrar", "municipal", "corporation", "nagar palika")),
    ),
    "stamp_paper": (
        Rule("Stamp Paper Serial Number Verification", 0.85, r"(?i)(?:serial|sr)\s*(?:no|number)?\s*[:-]?\s*([A-Z0-9]{6,20})", fallback=("stamp", "non-judicial", "e-stamp"), weak=("WARNING", 0.4)),
        Rule("Stamp Paper Issue Date Verification", 0.8, rf"(?i)(?:date\s*(?:of\s*)?issue|issued\s*on)\s*[:-]?\s*({DAY})"),
        Rule("Issuing Treasury Verification", 0.8, r"(?i)(?:treasury|sub[\s-]?treasury)\s*[:-]?\s*([A-Za-z\s]{3,30})"),
        Rule("Stamp Denomination Verification", 0.75, r"(?:Rs\.?|₹|INR)\s*([0-9,]+)"),
    ),
}
#: The registry that is asked for a department without one: such documents are checked as a driving school's.
OTHER = "driving_school"


#: Everything that rules ask a text for, looked for once.
_ALL_WORDS = tuple(sorted({w for ws in (MARKERS, SIGNATURES, AUTHORITIES, CASES, *WORDS.values(), *(x for rules in REGISTRIES.values() for r in rules for x in (r.words, r.fallback, r.only_if))) for w in ws}))
_PATTERNS = {r.name: re.compile(r.pattern, re.ASCII) for rules in REGISTRIES.values() for r in rules if r.pattern}
_DAY, _SERIAL, _ENDS = re.compile(DAY, re.ASCII), re.compile(SERIAL), re.compile(r"^\s+|\s+$", re.ASCII)


def _any(words: tuple[str, ...]) -> Column:
    """Whether one of words is among those that a text holds."""
    return F.arrays_overlap("present", F.array(*map(F.lit, words)))


def _count(words: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect("present", F.array(*map(F.lit, words))))


def _department(document_type: str, low: str) -> str:
    """The department by the document's type, else by the first of the ordered words in the text (in lower case), else general."""
    return DEPARTMENTS.get(document_type.lower()) or next((name for name, words in WORDS.items() if any(w in low for w in words)), "general")


#: ASCII characters that don't count as text.
_OTHERS = bytes(c for c in range(128) if not chr(c).isalpha() and chr(c) not in " \t\n\r\x0b\x0c")


def _share(text: str) -> float:
    """The share of letters and spaces."""
    n = len(text.encode().translate(None, _OTHERS)) if text.isascii() else sum(n for c, n in Counter(text).items() if _letter(c))
    return n / max(1, len(text))


@functools.cache
def _letter(c: str) -> bool:
    """Whether a character counts as text: a letter or a space."""
    return c in " \t\n\r\x0b\x0c" or unicodedata.category(c)[0] == "L"


def looked_at(docs: DataFrame) -> DataFrame:
    """docs(document_id, text, document_type, class_confidence, serial_number, qr_data, file_hash) with what rules ask for instead of the text: its
    department, number of words, share of letters and spaces, whether it is long enough (full), holds a day and a serial number (2 if it is the
    document's own), the words of rules that are present, and the names of the rules of its registry whose pattern hits. Texts are read once."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    slim = docs.select("document_id", F.col("class_confidence").cast("double").alias("class_confidence"), *map(plain, ("document_type", "serial_number", "qr_data", "file_hash", "text")))
    kept = ["document_id", "class_confidence", "document_type", "serial_number", "qr_data", "file_hash"]

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = {c: [] for c in ("department", "words", "share", "full", "day", "serial", "present", "hits")}
            for text, kind, serial in zip(*(batch.column(c).to_pylist() for c in ("text", "document_type", "serial_number")), strict=True):
                page = Page(text)
                low = page.low
                of = _department(kind, low)
                rows["department"].append(of)
                rows["words"].append(len(text.encode().split()))
                rows["share"].append(_share(text))
                rows["full"].append(len(_ENDS.sub("", text)) > 20)
                rows["day"].append(page.digit and _DAY.search(text) is not None)
                rows["serial"].append(2 if serial and serial in text else int(_SERIAL.search(text) is not None))
                rows["present"].append([w for w in _ALL_WORDS if w in low])
                rows["hits"].append([r.name for r in REGISTRIES.get(of, REGISTRIES[OTHER]) if r.pattern and page.may_hit(r.pattern) and _PATTERNS[r.name].search(text)])
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=[*kept, *rows])

    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in kept)
    return slim.mapInArrow(read, schema + ", department string, words int, share double, full boolean, day boolean, serial int, present array<string>, hits array<string>")


def _step(place: int, name: str, status: Column, confidence: Column) -> Column:
    """A step of the report; null without a status."""
    return F.when(status.isNotNull(), F.struct(F.lit(place).alias("step_order"), F.lit(name).alias("step_name"), status.alias("status"), confidence.cast("double").alias("confidence")))


def registry_steps(rules: tuple[Rule, ...]) -> list[Column]:
    """The steps of one registry, all at place 8, over looked_at's columns; a rule without an outcome gives null."""
    out = []
    for r in rules:
        hit = F.array_contains("hits", r.name) if r.pattern else _any(r.words)
        status, confidence = F.when(hit, "PASSED"), F.when(hit, r.passed)
        if r.weak:
            status, confidence = status.when(_any(r.fallback), r.weak[0]), confidence.when(_any(r.fallback), r.weak[1])
        if r.rest:
            status, confidence = status.otherwise(r.rest[0]), confidence.otherwise(r.rest[1])
        if r.only_if:
            status = F.when(_any(r.only_if), status)
        out.append(_step(8, f"[Registry] {r.name}", status, confidence))
    return out


def _steps(docs: DataFrame) -> DataFrame:
    """document_id, department, steps (an array of structs) of each of docs."""
    seen = looked_at(docs).withColumn("template", F.least(_count(MARKERS) * 0.15 + F.when(F.col("day"), 0.2).otherwise(0.0) + F.when(_any(SIGNATURES), 0.2).otherwise(0.0), F.lit(1.0)))
    words, share, template, serial, content, held = map(F.col, ("words", "share", "template", "serial", "full", "class_confidence"))
    found, case = _count(AUTHORITIES), _any(CASES)
    good = (words >= 10) & (share > 0.6)
    typed = ~F.col("document_type").isin("", "other")
    qr = F.col("qr_data")
    readable = F.lower(qr).contains("http") | qr.rlike("[a-f0-9-]{36}")
    hashed = F.col("file_hash") != ""
    general = [
        _step(1, "Document Upload Validation", F.when(content, "PASSED").otherwise("FAILED"), F.when(content, 0.95).otherwise(0.1)),
        _step(2, "OCR Quality Assessment", F.when(good, "PASSED").when(words >= 5, "WARNING").otherwise("FAILED"), F.when(good, F.least(share, F.lit(0.95))).when(words >= 5, share * 0.7).otherwise(0.1)),
        _step(3, "AI Classification Verification", F.when(typed, "PASSED").otherwise("WARNING"), F.when(typed, F.greatest(F.coalesce(held, F.lit(0.5)), F.lit(0.7))).otherwise(0.3)),
        _step(4, "Serial Number Verification", F.when(serial == 2, "PASSED").when(serial == 1, "WARNING").otherwise("SKIPPED"), F.when(serial == 2, 0.9).when(serial == 1, 0.6).otherwise(0.0)),
        _step(5, "QR Code Verification", F.when(qr == "", "SKIPPED").when(readable, "PASSED").otherwise("WARNING"), F.when(qr == "", 0.0).when(readable, 0.85).otherwise(0.5)),
        _step(6, "Template Structure Verification", F.when(template >= 0.5, "PASSED").when(template >= 0.2, "WARNING").otherwise("FAILED"), template),
        _step(7, "Issuing Authority Verification", F.when(found > 0, "PASSED").otherwise("WARNING"), F.when(found > 0, F.least(0.5 + found * 0.1, F.lit(0.95))).otherwise(0.2)),
        _step(9, "Ongoing Case Check", F.when(case, "WARNING").otherwise("PASSED"), F.when(case, 0.6).otherwise(0.8)),
        _step(10, "Duplicate Document Check", F.when(hashed, "PASSED").otherwise("SKIPPED"), F.when(hashed, 0.9).otherwise(0.0)),
    ]
    registry = F.array(*registry_steps(REGISTRIES[OTHER]))
    for name, rules in REGISTRIES.items():
        if name != OTHER:
            registry = F.when(F.col("department") == name, F.array(*registry_steps(rules))).otherwise(registry)
    return seen.select("document_id", "department", F.filter(F.concat(F.array(*general), registry), lambda s: s.isNotNull()).alias("steps"))


def verification_steps(docs: DataFrame) -> DataFrame:
    """document_id, department, step_order, step_name, status, confidence: the steps 1 to 10 of each of docs(document_id, text,
    document_type, class_confidence, serial_number, qr_data, file_hash), long form.

    Null texts count as empty, a null class_confidence as .5. Texts are read once, and documents are checked where they lie.
    The duplicate step passes whenever a hash is given; exact_duplicates compares hashes.
    """
    return _steps(docs).select("document_id", "department", F.inline("steps"))


def verification_results(docs: DataFrame) -> DataFrame:
    """What verified() gives for the steps of docs, a row for each document: its steps are summed up in its own row, so nothing is shuffled."""
    done = lambda s: s["status"] != "SKIPPED"
    n = lambda name: F.size(F.filter("steps", lambda s: s["status"] == name)).cast("long")
    sure = F.aggregate(F.filter("steps", done), F.lit(0.0), lambda a, s: a + s["confidence"])
    sums = _steps(docs).select("document_id", F.size(F.filter("steps", done)).cast("long").alias("n"), n("PASSED").alias("p"), n("FAILED").alias("f"), n("WARNING").alias("w"), n("SKIPPED").alias("skipped"), sure.alias("sure"))
    return _graded(sums, 0.2, 0.5)


def verified(steps: DataFrame, green: float = 0.2, yellow: float = 0.5) -> DataFrame:
    """document_id, fraud_score, badge, confidence, passed, failed, warnings, skipped, needs_review of verification_steps' rows:
    the score over steps 1 to 10, then step 11 (its grade) and 12 (always passed) counted with them."""
    done, status = F.col("status") != "SKIPPED", F.col("status")
    n = lambda name: F.count_if(status == name)
    sums = steps.groupBy("document_id").agg(F.count_if(done).alias("n"), n("PASSED").alias("p"), n("FAILED").alias("f"), n("WARNING").alias("w"), n("SKIPPED").alias("skipped"), F.coalesce(F.sum(F.when(done, F.col("confidence"))), F.lit(0.0)).alias("sure"))
    return _graded(sums, green, yellow)


def _graded(sums: DataFrame, green: float, yellow: float) -> DataFrame:
    raw = (0.6 * F.col("f") + 0.2 * F.col("w")) / F.col("n") + 0.2 * (1 - F.col("sure") / F.col("n"))
    scored = sums.withColumn("fraud_score", F.when(F.col("n") == 0, 0.5).otherwise(F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4)))
    fraud = F.col("fraud_score")
    graded = scored.select(
        "document_id", "fraud_score", F.round((F.col("sure") + 1 - fraud + 1) / (F.col("n") + 2), 4).alias("confidence"), (F.col("p") + 1 + (fraud < green).cast("long")).alias("passed"),
        (F.col("f") + (fraud >= yellow).cast("long")).alias("failed"), (F.col("w") + ((fraud >= green) & (fraud < yellow)).cast("long")).alias("warnings"), "skipped",
    )
    badge = F.when((F.col("failed") > 0) | (fraud > yellow), "RED").when((F.col("warnings") > 0) | (fraud > green), "YELLOW").otherwise("GREEN")
    return graded.withColumn("badge", badge).withColumn("needs_review", F.col("badge") == "YELLOW")


def review_reasons(steps: DataFrame) -> DataFrame:
    """document_id, reason: the first five warned steps by name, for documents with a warning."""
    warned = steps.where("status = 'WARNING'").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("step_order", "step_name"))).alias("w"))
    names = F.transform(F.slice("w", 1, 5), lambda s: s["step_name"])
    return warned.select("document_id", F.concat(F.lit("Manual review needed ("), F.size("w").cast("string"), F.lit(" warnings): "), F.array_join(names, "; ")).alias("reason"))
