"""Items with their places in a text: dates and deadlines, amounts, numbers, people, organisations, places; profiles and timelines of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
COUNT = r"([0-9,]+(?:\.[0-9]{1,2})?)"
RUPEES = r"(?:Rs\.?|INR|₹)"
#: (category, pattern whose last group is the value, confidence), in the order in which a value is taken.
DATES = (
    ("date", r"\b([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4})\b", 0.9),
    ("date", r"\b([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2})\b", 0.7),
    ("date", rf"\b({MONTH}\s+[0-9]{{1,2}},?\s+[0-9]{{4}})\b", 0.95),
    ("date", rf"\b([0-9]{{1,2}}\s+{MONTH}\s+[0-9]{{4}})\b", 0.95),
    ("date", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 0.95),
)
AMOUNTS = (
    ("amount", rf"{RUPEES}\s*{COUNT}\s*(?:/-|lakh|crore|thousand)?", 0.9),
    ("amount", rf"{COUNT}\s*(?:rupees|/-)", 0.85),
    ("amount", rf"(?:amount|sum|total|fee|fine|penalty|cost)\s*(?:of|:)?\s*{RUPEES}?\s*{COUNT}", 0.85),
)
NUMBERS = (
    ("fir_number", r"\bFIR\s*(?:No\.?|Number)?\s*[:-]?\s*([0-9]{1,6}/[0-9]{2,4})", 0.95),
    ("case_number", r"\b((?:W\.?P\.?|C\.?A\.?|S\.?L\.?P\.?|Crl\.?\s*A\.?|Civil\s*Suit|Criminal\s*Case)\s*(?:\(C\)|\(Crl\))?\s*No\.?\s*[0-9]{1,8}(?:/[0-9]{2,4})?)", 0.9),
    ("case_number", r"\b(?:Case|Complaint|Appeal)\s*(?:No\.?|Number)\s*[:-]?\s*([A-Z0-9/-]{4,20})", 0.85),
    ("reference_number", r"\b(?:Ref|Reference)\s*(?:No\.?|Number)\s*[:-]?\s*([A-Z0-9/-]{4,20})", 0.8),
)
# fixed values: labels before people and places, kinds of organisations, and what a person's or an organisation's class is read from
PERSON_LABELS = (
    "name", "applicant", "petitioner", "respondent", "complainant", "accused", "plaintiff", "defendant", "father", "mother", "husband", "wife", "son", "daughter", "witness",
    "judge", "magistrate", "officer", "inspector", "collector", "commissioner", "registrar", "superintendent",
)
RELATED = r"([A-Z][a-zA-Z.\s]{2,30}?)\s+(?:S/o|D/o|W/o|son of|daughter of|wife of)\s+([A-Z][a-zA-Z.\s]{2,30})"
ORGANISATIONS = (
    (r"\b((?:Ministry|Department|Directorate|Bureau|Commission|Authority|Board|Council|Office|Secretariat|Division)\s+(?:of\s+)?[A-Z][a-zA-Z\s&,]{3,50})", 0.85),
    (r"\b((?:District|State|Central|National|Regional)\s+(?:Court|Tribunal|Commission|Authority|Board|Office)[A-Za-z\s,]{0,30})", 0.80),
    (r"\b((?:High Court|Supreme Court|District Court|Sessions Court|Magistrate Court|Tribunal)\s*(?:of\s+)?[A-Za-z\s]{0,30})", 0.90),
    (r"\b((?:Police Station|Thana)\s+[A-Za-z\s]{2,30})", 0.85),
    (r"\b((?:Municipal\s+Corporation|Nagar\s+Palika|Gram\s+Panchayat|Zilla\s+Parishad)\s*(?:of\s+)?[A-Za-z\s]{0,30})", 0.85),
    (r"\b([A-Z][a-zA-Z\s]{2,30}(?:University|Institute|College|School|Academy))", 0.80),
)
PLACE_LABELS = ("address", "place", "village", "town", "city", "district", "state", "taluka", "tehsil", "block", "ward", "locality", "place of birth", "place of issue", "place of occurrence", "residence", "resident of")
OFFICERS = (
    "judge", "magistrate", "justice", "inspector", "collector", "commissioner", "superintendent", "registrar", "director", "secretary", "tehsildar", "sdo", "bdo", "dsp", "sp", "ssp",
    "igs", "digs", "sub-inspector", "constable", "advocate", "prosecutor", "public prosecutor", "controller", "auditor", "minister", "governor", "president", "chairman", "chairperson",
)
ROLES = ("applicant", "petitioner", "respondent", "complainant", "accused", "plaintiff", "defendant", "witness", "deponent", "beneficiary", "licensee", "holder", "owner", "tenant", "buyer", "seller", "lessee", "lessor")
COURTS = ("supreme court", "high court", "district court", "sessions court", "magistrate court", "tribunal", "appellate", "bench", "lok adalat", "fast track court", "family court", "consumer court", "labour court", "nclt", "nclat", "itat", "cestat", "cat")
INSTITUTIONS = ("university", "institute", "college", "school", "academy", "hospital", "polytechnic", "iit", "iim", "nit", "aiims")
TITLED = r"\b((?:Shri|Smt|Dr\.|Mr\.|Mrs\.|Ms\.|Justice|Hon'?ble|Adv\.?)\s+[A-Z][a-zA-Z.\s]{2,30})"
# fixed values: event types by words, in order, and what dates without a sentence are read from
EVENTS = (
    ("filing", ("filed", "filing", "submitted", "lodged", "registered complaint")),
    ("issuance", ("issued", "granted", "sanctioned", "approved", "certified")),
    ("hearing", ("hearing", "next date", "adjourned", "listed", "posted")),
    ("deadline", ("deadline", "last date", "due date", "expiry", "expires", "valid until", "valid till")),
    ("birth", ("born", "date of birth", "dob")),
    ("expiry", ("expired", "lapsed", "expiry", "expires on")),
    ("order", ("ordered", "directed", "decreed", "judgment", "verdict")),
    ("occurrence", ("occurred", "happened", "incident", "occurrence", "took place")),
    ("registration", ("registered", "registration", "enrolled")),
    ("amendment", ("amended", "modified", "revised", "updated")),
)
FIELD_EVENTS = {
    "date_of_birth": "Birth", "issue_date": "Issuance", "expiry_date": "Expiration", "date_filed": "Filing", "statement_date": "Statement", "hearing_date": "Hearing", "judgment_date": "Judgment",
    "invoice_date": "Invoice", "due_date": "Due Date", "contract_date": "Contract Signing", "effective_date": "Effective Date", "receipt_date": "Receipt", "event_date": "Event", "application_date": "Application", "date": "Date",
}
DAY = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}"
TOLD = (rf"(?:on|dated)\s+(?P<day>{DAY})\s*(?:[,;]\s*)?(?P<what>.{{10,80}})", rf"(?P<what>.{{10,60}})\s+(?:on|dated)\s+(?P<day>{DAY})")
# fixed values: names that a text's form shows, phrases of a field, and sentences that state a relation
SUBJECT, OBJECT, LOW = r"([A-Z][a-z]+(?:\s+[A-Za-z]+)*)", r"([A-Za-z]+(?:\s+[A-Za-z]+)*)", r"([a-z]+(?:\s+[a-z]+)*)"
FORMS = (("URL", r"https?://[^\s]+"), ("Email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"), ("FilePath", r"(?:/[^/]+)+\.[a-zA-Z0-9]+"), ("Version", r"\b[0-9]+\.[0-9]+(?:\.[0-9]+)?(?:-[a-zA-Z0-9]+)?\b"))
PHRASES = {"Technology": ("ai", "artificial intelligence", "machine learning", "deep learning", "neural network", "nlp", "natural language processing"), "Concept": ("rag", "retrieval augmented generation", "knowledge graph", "vector database", "embeddings")}
STATED = (
    ("is_a", rf"{SUBJECT} is (?:a|an) {LOW}"), ("is_a", rf"{SUBJECT} are {LOW}"), ("part_of", rf"{SUBJECT} is part of {OBJECT}"), ("part_of", rf"{SUBJECT} belongs to {OBJECT}"),
    ("has_property", rf"{SUBJECT} has {LOW}"), ("has_property", rf"{SUBJECT} contains {LOW}"), ("creates", rf"{SUBJECT} creates {OBJECT}"), ("creates", rf"{SUBJECT} produces {OBJECT}"),
    ("creates", rf"{SUBJECT} generates {OBJECT}"), ("uses", rf"{SUBJECT} uses {OBJECT}"), ("uses", rf"{SUBJECT} utilizes {OBJECT}"), ("uses", rf"{SUBJECT} leverages {OBJECT}"),
)
_TOLD = tuple(re.compile(p, re.IGNORECASE) for p in TOLD)
_SHORT_DAY, _SAID = re.compile("[0-9][/.-][0-9]{1,2}[/.-][0-9]"), re.compile(rf"(?<=\s)(?:on|dated)\s+{DAY}", re.IGNORECASE)
_FORMS = tuple((kind, re.compile(p)) for kind, p in FORMS)
#: Relation, where its verb may start (verbs may share a space), verb and object, and the letters with which the verb starts.
_STATED = tuple((kind, re.compile(f"(?={p.removeprefix(SUBJECT).removesuffix(LOW).removesuffix(OBJECT)})"), re.compile(p.removeprefix(SUBJECT)), re.match("[a-z ]+", p.removeprefix(SUBJECT))[0]) for kind, p in STATED)
_LETTERS, _CAPITAL = re.compile(r"[A-Za-z\s]+"), re.compile(r"[A-Z][a-z]+(?=\s)")
_CHAIN, _POINT = re.compile("(?:/[^/]++)++"), re.compile(r"(?<=[^/])\.[a-zA-Z0-9]+")
_MAIL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@-")
_MAIL_RUN, _MAIL_END = re.compile("[A-Za-z0-9._%+@-]*[A-Za-z0-9._%+@|-]*"), re.compile(r"@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b")
_PEOPLE = tuple(re.compile(rf"(?:{label})\s*[:-]\s*([A-Z][a-zA-Z.\s]{{2,40}}?)(?:\s*[,\n\r]|\s+(?:S/o|D/o|W/o|son|daughter|age|aged|resident))", re.IGNORECASE) for label in PERSON_LABELS)
_PLACES = tuple(re.compile(rf"(?:{label})\s*[:-]\s*([A-Za-z][A-Za-z\s,.-]{{2,60}}?)(?:\s*[;\n\r]|,\s*(?:Pin|PIN|Dist|State|Ph))", re.IGNORECASE) for label in PLACE_LABELS)
# what a text must hold for the patterns above to find anything: most texts are passed over by these alone
_LABELS = (*PERSON_LABELS, *PLACE_LABELS)
_RELATIVES = ("S/o", "D/o", "W/o", "son of", "daughter of", "wife of")
_HEADS = re.compile("Ministry|Department|Directorate|Bureau|Commission|Authority|Board|Council|Office|Secretariat|Division|Court|Tribunal|Police|Thana|Municipal|Nagar|Gram|Zilla|University|Institute|College|School|Academy")
_DIGIT = re.compile(r"[0-9]|(?:case|complaint|appeal|ref|reference)\s*(?:no|number)", re.IGNORECASE)
_PIN = re.compile(r"\b([0-9]{6})\b")
_ORGANISATIONS = tuple((re.compile(p), c) for p, c in ORGANISATIONS)
DEADLINE = re.compile("deadline|due date|last date|expiry|expires|valid (?:until|till|up to)|before|not later than|by|within")
_KINDS = tuple(tuple((c, re.compile(p, re.IGNORECASE), x) for c, p, x in kind) for kind in (DATES, AMOUNTS, NUMBERS))


def items(text: str) -> list[tuple[str, str, float, str, int]]:
    """(category, value, confidence, evidence, position): each value once per kind, by the first pattern that finds it.

    A date is a deadline, and .05 surer, if a word for one stands in the 80 characters before it. Commas go from amounts.
    """
    out = []
    if not _DIGIT.search(text):
        return out
    for kind, around in zip(_KINDS, (50, 40, 40)):
        seen = set()
        for category, pattern, confidence in kind:
            for m in pattern.finditer(text):
                value = m[1].replace(",", "") if category == "amount" else m[1]
                if value in seen or not value or (category == "amount" and not value[0].isdigit()):
                    continue
                seen.add(value)
                due = category == "date" and DEADLINE.search(text[max(0, m.start() - 80) : m.start()].lower())
                evidence = text[max(0, m.start() - around) : m.end() + around].strip()
                out.append(("deadline" if due else category, value, round(confidence + 0.05 * bool(due), 2), evidence, m.start()))
    return out


def named(text: str) -> list[tuple[str, str, float, str, int]]:
    """(category, value, confidence, evidence, position) of people, organisations and places. People are told by case, the others in any;
    each value counts once, by the first pattern that finds it."""
    out, seen = [], set()

    def add(category, value, confidence, evidence, at, least, key=None):
        key = value if key is None else key
        if len(value) >= least and (category, key) not in seen:
            seen.add((category, key))
            out.append((category, value, confidence, evidence.strip(), at))

    near = lambda m, n: text[max(0, m.start() - n) : m.end() + n]
    labelled = any(text[max(0, m.start() - 40) : m.start()].rstrip().lower().endswith(_LABELS) for m in re.finditer("[:-]", text))
    for p in _PEOPLE if labelled else ():
        for m in p.finditer(text):
            add("person", m[1].strip().rstrip(".,;:"), 0.80, near(m, 20), m.start(), 3)
    for m in re.finditer(RELATED, text) if any(w in text for w in _RELATIVES) else ():
        for g in (1, 2):
            add("person", m[g].strip().rstrip(".,;:"), 0.75, m[0][:100], m.start(), 3)
    for p, confidence in _ORGANISATIONS if _HEADS.search(text) else ():
        for m in p.finditer(text):
            value = m[1].strip().rstrip(".,;:")
            add("organization", value, confidence, near(m, 30), m.start(), 5, value.lower())
    for p in _PLACES if labelled else ():
        for m in p.finditer(text):
            value = m[1].strip().rstrip(".,;:")
            add("location", value, 0.75, near(m, 20), m.start(), 3, value.lower())
    for m in _PIN.finditer(text):
        if any(w in text[max(0, m.start() - 40) : m.start()].lower() for w in ("pin", "zip", "postal", "code")):
            add("location", f"PIN {m[1]}", 0.70, text[max(0, m.start() - 30) : m.end() + 10], m.start(), 3, m[1])
    return out


def profiles(text: str) -> list[tuple[str, str, str, float, str]]:
    """(type, name, role, confidence, evidence): officers and citizens, courts, institutions and departments, and titled officers that
    aren't among the officers. Of several words that fit, the first in the lists' order names the role."""
    out = []
    for category, name, confidence, evidence, _ in named(text):
        low = (evidence if category == "person" else name).lower()
        if category == "person":
            title = next((w for w in OFFICERS if w in low), None)
            role = title or next((w for w in ROLES if w in low), "")
            out.append(("officer" if title else "citizen", name, role.title(), confidence, evidence))
        elif category == "organization":
            kind, role = ("court", "court") if any(w in low for w in COURTS) else ("institution", "institution") if any(w in low for w in INSTITUTIONS) else ("department", "government department")
            out.append((kind, name, role, confidence, evidence))
    held, seen = {n.lower() for kind, n, *_ in out if kind == "officer"}, set()
    for m in re.finditer(TITLED, text):
        name = m[1].strip().rstrip(".,;:")
        low = name.lower()
        if len(name) >= 5 and low not in seen:
            seen.add(low)
            if low not in held:
                held.add(low)
                role = "Judge" if "justice" in low or "hon" in low else "Doctor/Official" if "dr." in low else "Official"
                out.append(("officer", name, role, 0.80, text[max(0, m.start() - 30) : m.end() + 30].strip()))
    return out


def event_type(text: str) -> str:
    low = text.lower()
    return next((kind for kind, words in EVENTS if any(w in low for w in words)), "other")


def _told(text: str) -> Iterator[re.Match]:
    """The hits of TOLD. What stands before a day is looked for near each 'on' or 'dated' of one alone: its hits start at most 60 characters
    before the space between."""
    if not _SHORT_DAY.search(text):
        return
    after, before = _TOLD
    yield from after.finditer(text)
    at = 0
    for said in _SAID.finditer(text):
        space = said.start()
        while space and text[space - 1].isspace():
            space -= 1
        at = max(at, space - 60)
        while at < said.start() - 10:
            if m := before.match(text, at):
                yield m
                at = m.end()
            else:
                at += 1


def timeline(text: str) -> list[tuple[str, str, str, float, int]]:
    """(date, event type, description, confidence, position): each date with the 120 characters around it, the sentence that holds it as its
    description; then 'on' and 'dated' phrases of dates that weren't seen. Positions of phrases are their starts."""
    out, seen = [], set()
    for _, value, confidence, _, at in (x for x in items(text) if x[0] in ("date", "deadline")):
        seen.add(value)
        around = text[max(0, at - 120) : at + len(value) + 120].strip()
        kind = event_type(around)
        told = next((s.strip() for s in re.split(r"[.!?]\s+", around) if value in s and len(s.strip()) > 15), None)
        out.append((value, kind, told or f"{kind.title()} on {value}", confidence, at))
    for m in _told(text):
        if m["day"] not in seen:
            seen.add(m["day"])
            out.append((m["day"], event_type(m["what"]), m["what"].strip().rstrip(".,;:"), 0.75, m.start()))
    return out


def _rows(docs: DataFrame, read, schema: str) -> DataFrame:
    """A row with doc_id for each tuple that read gives for a text."""

    def found(batches: Iterator):
        import pyarrow as pa

        kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
        fields = [f.split() for f in schema.split(", ")]
        for batch in batches:
            rows = [(i.as_py(), *x) for i, t in zip(batch.column("doc_id"), batch.column("text")) for x in read(t.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(found, schema)


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, category, value, confidence, evidence, position: the items of docs(doc_id, text); positions are code points."""
    return _rows(docs, items, "doc_id long, category string, value string, confidence double, evidence string, position long")


def everything(docs: DataFrame) -> DataFrame:
    """The items and the people, organisations and places of docs, in one pass."""
    return _rows(docs, lambda t: items(t) + named(t), "doc_id long, category string, value string, confidence double, evidence string, position long")


def entity_profiles(docs: DataFrame) -> DataFrame:
    """doc_id, type, name, role, confidence, evidence, entity_id: the id is a hash of type and name, so it agrees between runs."""
    found = _rows(docs, profiles, "doc_id long, type string, name string, role string, confidence double, evidence string")
    return found.withColumn("entity_id", F.concat_ws("_", F.substring("type", 1, 3), F.hex(F.xxhash64("type", "name"))))


def document_timeline(docs: DataFrame) -> DataFrame:
    """doc_id, date, date_iso, event_type, description, confidence, place: events by ISO date, or by the text of the date where it doesn't parse."""
    found = _rows(docs, timeline, "doc_id long, date string, event_type string, description string, confidence double, position long")
    iso = F.date_format(T.parsed_date(F.col("date"), T.DATE_FORMATS + T.SHORT_DATE_FORMATS), "yyyy-MM-dd")
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("date_iso", "date"), "position", "date")
    return found.withColumn("date_iso", iso).withColumn("place", F.row_number().over(order)).drop("position")


def field_events(fields: DataFrame) -> DataFrame:
    """document_id, date, event_type, field of fields(document_id, field, value): those whose names say that they are dates, parsed; others and
    dates that don't parse give no row."""
    kinds = F.create_map(*[F.lit(x) for kv in FIELD_EVENTS.items() for x in kv])
    day = T.parsed_date(F.col("value"), T.FIELD_DATE_FORMATS)
    rows = fields.withColumn("event_type", F.try_element_at(kinds, F.lower("field"))).withColumn("date", F.date_format(day, "yyyy-MM-dd"))
    return rows.where("event_type is not null and date is not null").select("document_id", "date", "event_type", "field")


def summaries(found: DataFrame) -> DataFrame:
    """doc_id, items, confidence (the mean), summary of everything's rows: up to five people, organisations and dates, three of the others."""
    of = lambda c, n: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("position", "value")))), lambda x: x["value"]), 1, n).alias(c)
    most = {"person": ("People mentioned", 5), "organization": ("Organizations", 5), "date": ("Important dates", 5), "deadline": ("Deadlines", 3), "amount": ("Amounts", 3), "case_number": ("Case references", 3), "location": ("Locations", 3)}
    held = found.groupBy("doc_id").agg(F.count("*").alias("items"), F.round(F.avg("confidence"), 3).alias("confidence"), *[of(c, n) for c, (_, n) in most.items()])
    lines = [F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "), F.lit("."))) for c, (label, _) in most.items()]
    return held.select("doc_id", "items", "confidence", F.concat_ws("\n", *lines).alias("summary"))


def _paths(text: str) -> list[str]:
    """The hits of FilePath: of each chain of parts after slashes, up to the last point within a part that letters or digits follow."""
    out = []
    for chain in _CHAIN.finditer(text):
        if (points := [m.end() for m in _POINT.finditer(chain[0])]):
            out.append(chain[0][: points[-1]])
    return out


def _mails(text: str, pattern: re.Pattern) -> list[str]:
    """The hits of Email, in the runs of its characters alone that hold the end of one."""
    out, at = [], 0
    while (at := text.find("@", at)) >= 0:
        low = at
        while low and text[low - 1] in _MAIL_CHARACTERS:
            low -= 1
        high = _MAIL_RUN.match(text, at).end()
        if _MAIL_END.search(text, at, high + 1):
            out += pattern.findall(text, low, high + 1)
        at = high
    return out


def formal(text: str) -> list[tuple[str, str, float]]:
    """(name, type, confidence): addresses, paths and versions by their form (.8), phrases of technology and concepts in any case (.7); each name of a
    type once."""
    words = f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "
    hits = {"FilePath": lambda p: _paths(text), "Email": lambda p: _mails(text, p)}
    shown = [(m, kind, 0.8) for kind, p in _FORMS for m in (hits[kind](p) if kind in hits else p.findall(text))]
    return list(dict.fromkeys(shown + [(p, kind, 0.7) for kind, ps in PHRASES.items() for p in ps if f" {p} " in words]))


def stated(text: str) -> list[tuple[str, str, str, float]]:
    """(subject, relation, object, confidence) that sentences of STATED's forms say, each once in any case.

    A sentence's words lie in one run of letters and spaces. Subjects take all words that they can, so a run says a relation once: from its first
    capital word to the last verb behind which an object stands. Verbs are tried only in texts and runs that hold their letters.
    """
    found = {}
    held = [x for x in _STATED if x[3] in text]
    for run in _LETTERS.findall(text) if held else ():
        for kind, verb, whole, head in held:
            if head not in run:
                continue
            places = [m.start() for m in verb.finditer(run) if m.start() and not run[m.start() - 1].isspace()]
            last = next(((at, m) for at in reversed(places) if (m := whole.match(run, at))), None)
            if last and (start := _CAPITAL.search(run, 0, last[0] + 1)):
                subject, object_ = run[start.start() : last[0]], last[1][1]
                key = (subject.lower(), kind, object_.lower())
                found[key] = min(found.get(key, (subject, kind, object_)), (subject, kind, object_))
    return [(*x, 0.7) for x in found.values()]


def formal_entities(docs: DataFrame) -> DataFrame:
    """doc_id, name, type, confidence of formal(text). A language model's entities aren't part of it."""
    return _rows(docs, formal, "doc_id long, name string, type string, confidence double")


def stated_relations(docs: DataFrame) -> DataFrame:
    """doc_id, src, type, dst, confidence of stated(text)."""
    return _rows(docs, stated, "doc_id long, src string, type string, dst string, confidence double")


def entity_relevance(docs: DataFrame, vertices: DataFrame) -> DataFrame:
    """doc_id, name, occurrences, position, relevance of vertices(name) that a text contains: .5 of the occurrences per hundred characters, .3 of how early
    the first is, .2 of the share of the name's first word among the text's words; 1 at most."""
    from . import joins

    texts = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    both = joins.mentions(docs, vertices).join(texts, "doc_id").withColumn("low", F.lower("name"))
    n = (F.length("t") - F.length(F.replace("t", "low"))) / F.length("low")
    first = F.expr("locate(low, t)") - 1
    words = F.regexp_extract_all("t", F.lit(r"[\pL\pN_]+"), F.lit(0))
    head = F.element_at(F.split("low", r"\s+"), 1)
    share = F.when(F.length(head) > 2, F.size(F.filter(words, lambda w: w == head)) / F.greatest(F.size(words), F.lit(1))).otherwise(0.0)
    score = F.least(F.lit(1.0), n / F.greatest(F.length("t") / 100, F.lit(1.0)) * 0.5 + (1 - first / F.greatest(F.length("t"), F.lit(1))) * 0.3 + share * 0.2)
    return both.select("doc_id", "name", n.cast("long").alias("occurrences"), first.alias("position"), F.round(score, 6).alias("relevance"))
