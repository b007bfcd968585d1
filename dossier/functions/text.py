"""Text functions as Column expressions: cleaning, tokens, normalisers, extraction, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
# fixed values
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy")
SHORT_DATE_FORMATS = ("dd/MM/yy", "dd-MM-yy", "MMMM d yyyy")
FIELD_DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "d MMMM yyyy")
FIELD_ALIASES = {"name": "full_name", "applicant_name": "full_name", "holder_name": "full_name", "deponent_name": "full_name", "dob": "date_of_birth", "birth_date": "date_of_birth", "phone": "contact_number", "mobile": "contact_number"}
FIELD_TYPES = (("date", ("date", "dob", "birth", "issue", "expiry", "valid")), ("number", ("amount", "fee", "price", "cost", "salary", "income")), ("email", ("email",)), ("phone", ("phone", "mobile", "contact", "tel")))
INTENTS = (
    ("about", r"what\s+(?:is|does)\s+this\s+document\s+(?:about|contain|say)|summary|summarize|summarise|overview|describe|what\s+(?:is|are)\s+the\s+(?:content|subject|topic)"),
    ("department", r"which\s+department|issued\s+by|issuing\s+(?:authority|body|office)|who\s+issued|department|authority|ministry|office"),
    ("verified", r"is\s+(?:it|this|the\s+document)\s+verified|verification\s+status|trust\s+(?:badge|level|score)|authentic|genuine|valid|legitimate"),
    ("deadline", r"deadline|due\s+date|last\s+date|expir|when\s+(?:does|will)\s+(?:it|this)\s+expire|valid\s+(?:until|till|upto)"),
    ("ongoing_case", r"ongoing\s+case|active\s+case|pending\s+case|is\s+there\s+(?:a|an|any)\s+(?:ongoing|active|pending)\s+case|case\s+status|fir|complaint"),
    ("person", r"who\s+(?:is|are)|person|people|name|citizen|officer|applicant|petitioner|respondent|accused|complainant"),
    ("date", r"(?:what|when)\s+(?:is|are)\s+the\s+(?:important|key)?\s*date|date\s+of\s+(?:issue|birth|filing|hearing)"),
    ("amount", r"(?:what|how\s+much)\s+(?:is|are)\s+the\s+(?:amount|fee|fine|cost)|(?:Rs|rupee|INR|amount|sum|total|fee|fine|penalty)"),
    ("location", r"where|location|address|place|district|state|city|jurisdiction|area|region"),
)
NUMERIC_DATE = r"\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\b[0-9]{10}\b"
AMOUNT = r"(?:Rs\.?|INR|₹|USD|\$)\s?([0-9][0-9,]*(?:\.[0-9]+)?)"
HONORIFIC = r"Mr\.|Mrs\.|Ms\.|Shri|Smt|Dr\."
REFERENCE = r"\b(?:Case|FIR|Ref)\.?\s*No\.?\s*:?\s*([A-Z0-9/-]+)"


def clean(text) -> Column:
    """Line ends become \\n, three or more of them two, runs of spaces one; control characters go; words hyphenated at a line
    end are joined; the ends are trimmed of spaces. Null stays null."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"([a-z])-\n([a-z])", "$1$2")
    out = F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), " {2,}", " ")
    return F.trim(out)


def tokens(text) -> Column:
    """Lower-case words between white space; none for null or blank."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def word_count(text) -> Column:
    return F.size(tokens(text)).cast("long")


def letter_share(text) -> Column:
    """Share of ASCII letters and spaces among the characters, 0 for empty or null text."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[^A-Za-z ]", "")), F.length(text)), F.lit(0.0))


def normal_name(name) -> Column:
    """Titles go wherever they stand, spaces are squeezed, words are capitalised."""
    bare = F.regexp_replace(name, r"(?i)\b(Mr|Mrs|Ms|Dr|Prof|Sir|Madam)\.?\b", "")
    return F.initcap(F.trim(F.regexp_replace(bare, SPACE, " ")))


def normal_date(text) -> Column:
    """The first yyyy-MM-dd, dd/MM/yyyy or dd-MM-yyyy in a text, in that order, as yyyy-MM-dd; null without one. Days aren't checked."""
    out = F.lit(None).cast("string")
    for p in ("([0-9]{2})-([0-9]{2})-([0-9]{4})", "([0-9]{2})/([0-9]{2})/([0-9]{4})"):
        g = [F.regexp_extract(text, p, i) for i in (3, 2, 1)]
        out = F.when(text.rlike(p), F.concat_ws("-", *g)).otherwise(out)
    return F.when(text.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.regexp_extract(text, "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)).otherwise(out)


def normal_phone(phone) -> Column:
    """The last ten digits, after a leading 91 of more than ten."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits)


def normal_address(address) -> Column:
    return F.trim(F.regexp_replace(F.lower(address), SPACE, " "))


def parsed_date(text, formats=DATE_FORMATS) -> Column:
    """The first format that fits, day first; null where none does."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def alias(field, aliases=None) -> Column:
    """The common name of a field: lower case, spaces as underscores, aliases resolved."""
    plain = F.regexp_replace(F.lower(F.trim(field)), " +", "_")
    pairs = F.create_map(*[F.lit(x) for kv in (aliases or FIELD_ALIASES).items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, plain), plain)


def field_type(field, rules=FIELD_TYPES) -> Column:
    """The first type with a keyword in the field's name, else string."""
    out = F.lit("string")
    for kind, words in reversed(rules):
        out = F.when(F.lower(field).rlike("|".join(words)), kind).otherwise(out)
    return out


def intent(question, rules=INTENTS) -> Column:
    """The first intent whose pattern occurs in the question in lower case, else general. Capitals in a pattern never match."""
    out = F.lit("general")
    for name, pattern in reversed(rules):
        out = F.when(F.lower(F.trim(question)).rlike(pattern), name).otherwise(out)
    return out


def found(text, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern in order, null text as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def subnet(ip, parts: int = 3) -> Column:
    """The first parts of an IPv4 address; anything else as it is."""
    return F.when(ip.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.substring_index(ip, ".", parts)).otherwise(ip)


def fingerprint(*columns) -> Column:
    """SHA-256 of the columns joined by bars, null as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def slices(text, size: int) -> Column:
    """Fixed slices of size characters, the last one shorter; none for empty or null text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size))))


def hmac(message, key: bytes) -> Column:
    """HMAC-SHA256 of a string in lower-case hex, from sha2 alone."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))), 256)
