"""Company names: predicates, scores and cleanup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions.text import alpha_ratio, hits, let, squeeze, strip_chars, sub

# --- fixed values: words and patterns of company names ---------------------------------------------
NAME_STOP = (
    r"(?i)\b(?:GSTIN|GST|STATE|PLACE\s+OF\s+SUPPLY|PO\s*NO(?:/DATE)?|DATE|EMAIL|MOBILE|PHONE|PAN)\b"
)
NAME_LABELS = r"(?i)RECIPIENT|ADDRESS|NAME|CONSIGNEE"
BUSINESS_WORDS = (
    r"(?i)\b(PVT|PRIVATE|LTD|LIMITED|LLP|COMPANY|TRADING|CEMENT|ENGINEERS?|AGENCIES|AGENCY|SOLUTIONS|TECH|"
    r"ENTERPRISES|LOGISTICS|SYSTEMS)\b"
)
LEGAL_FORM_PREFIX = (
    r"(?is)^(.*?\b(?:PRIVATE\s+LIMITED|PVT\.?\s*LTD|LIMITED|LTD|LLP|LLC|INC|CO\.?))\b.*$"
)
SUFFIX_WORDS = ("pvt", "ltd", "private", "limited", "llp", "co", "company", "inc", "corp", "gmbh")
COMPANY_ENDINGS = (
    "LTD", "LIMITED", "PVT LTD", "PRIVATE LIMITED", "PRIVATE LTD", "INC", "CORP", "METALS", "CEMENT", "STEEL",
    "SOLUTIONS", "WORKS", "SERVICES", "SYSTEMS", "TECHNOLOGIES", "ENTERPRISES", "INDUSTRIES",
    "INFRASTRUCTURES", "BLUE METALS",
)
SCORED_ENDINGS = (
    "PVT LTD", "PRIVATE LIMITED", "LIMITED", "LTD", "METALS", "CEMENT", "STEEL", "SOLUTIONS", "WORKS",
    "SERVICES", "TECHNOLOGIES",
)
ADDRESS_WORDS = (
    "ROAD", "VILLAGE", "VILL", "STREET", "ST", "MAIN", "FLR", "FLOOR", "POST", "DIST", "DISTRICT",
)
ADDRESS_LINE = (
    r"(?i)\d{6}|ROAD|STREET|VILLAGE|VILL|DIST|POST|BENGALURU|CHENNAI|HYDERABAD|PUNE|MUMBAI|DELHI|"
    r"TAMIL\s*NADU|KARNATAKA|MAHARASHTRA|TELANGANA|STATE\s*\d|SY\s*NO"
)
LABEL_LINE = r"(?i)recipient|consignee|address|sales|category|dc\.no|yc\.no"
FREIGHT_TERMS = r"(?i)(\bfreight\b.*|freight on this invoice|payable by)"
LEGAL_FORM_START = r"(?i)^\s*(PVT\.?\s*LTD\.?|LTD\.?|PRIVATE\.?|CO\.?\b).*"
CONFIDENT_WORDS = (
    r"(?i)\b(LIMITED|LTD|PVT|PRIVATE|AGENCIES|AGENCY|TRADERS|CONSTRUCTION|ENGINEERS|CO\.?|SOLUTIONS|TECH)\b"
)
CODE_TOKEN = r"\b[A-Z]{2,6}(?:/[A-Z0-9\-\./]+)+\b"
SAFE_CAPITALS = ("LLP", "LTD", "PVT", "PVT.", "CO", "INC", "PLC", "GST", "PAN")
COMMON_MISREADS = (("FRADERS", "TRADERS"), ("FRADING", "TRADING"), ("FRANSPORT", "TRANSPORT"))
# --------------------------------------------------------------------------------------------------


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def is_company_line(line: Column) -> Column:
    """R11."""
    upper = F.trim(F.upper(line))
    blocked = upper.rlike(NAME_STOP) | upper.rlike(NAME_LABELS)
    capitals = (upper == F.trim(line)) & word_count(upper).between(1, 6) & (F.length(upper) >= 4)
    lettered = line.rlike("[A-Za-z]") & ~line.rlike(r"[_\[\]\{\}]{2,}")
    return F.coalesce((F.length(line) > 0) & (lettered | upper.rlike(BUSINESS_WORDS) | capitals) & ~blocked, F.lit(False))


def is_valid_company(name: Column) -> Column:
    """R12."""
    upper = F.trim(F.upper(name))
    base = F.trim(F.substring_index(upper, "-", 1))
    spaces = F.length(name) - F.length(F.replace(name, F.lit(" "), F.lit("")))
    ending = reduce(lambda a, b: a | b, [F.endswith(base, F.lit(e)) | F.endswith(upper, F.lit(e)) for e in COMPANY_ENDINGS])
    shape = (
        (F.length(name) >= 8)
        & (F.length(sub(name, r"[^\p{L}]")) >= F.length(name) * 0.5)
        & (spaces <= F.length(name) / 3)
        & ~name.rlike(r"[^A-Za-z0-9\s\(\)\-]{3,}")
    )
    kind = ending | F.contains(upper, F.lit("INDIA)")) | ((word_count(upper) >= 2) & upper.rlike(r"\p{Lu}"))
    return F.coalesce(shape & kind, F.lit(False))


def is_suffix_only(name: Column) -> Column:
    """Nothing but legal forms and scraps of one or two letters."""
    cores = F.transform(F.split(name, r"\s+|[,|\\/]"), lambda w: F.lower(sub(w, "[^A-Za-z]")))
    return F.forall(cores, lambda w: (F.length(w) <= 2) | w.isin(*SUFFIX_WORDS))


def needs_review(name: Column) -> Column:
    """R14."""
    return (
        name.isNull() | (F.trim(name) == "") | name.rlike(LEGAL_FORM_START)
        | (F.length(F.trim(name)) < 6) | name.rlike(r"(?i)([A-Za-z])\1\1") & name.rlike(r"([A-Za-z])\1\1")
    )


def name_confidence(name: Column) -> Column:
    """F21."""
    s = F.trim(name)
    score = (
        alpha_ratio(s) * 0.6
        + F.when(s.rlike(CONFIDENT_WORDS), 0.25).otherwise(0.0)
        + F.when(word_count(s) >= 2, 0.10).otherwise(0.0)
    )
    return F.when(s.rlike("[A-Za-z]"), F.least(score, F.lit(1.0))).otherwise(0.0)


def company_score(name: Column) -> Column:
    """F22."""
    upper = F.upper(name)
    base = F.trim(F.substring_index(upper, "-", 1))
    ending = reduce(lambda a, b: a | b, [F.endswith(base, F.lit(e)) | F.endswith(upper, F.lit(e)) for e in SCORED_ENDINGS])
    penalty = reduce(lambda a, b: a + b, [
        F.when(F.contains(upper, F.lit(" " + w)) | F.contains(upper, F.lit(w + " ")), 10).otherwise(0) for w in ADDRESS_WORDS])
    score = (
        F.least(F.length(name) / 5, F.lit(10.0))
        + F.when(ending, 20).otherwise(0)
        + F.when(upper.rlike(r"\([A-Z]+\)"), 15).otherwise(0)
        - penalty
        - F.when(F.trim(name).startswith(")"), 20).otherwise(0)
    )
    return F.when(F.length(name) > 0, score).otherwise(0.0)


def collapse_repeat(text: Column) -> Column:
    """a phrase that follows itself is kept once; an unclosed bracket at the end goes first."""
    trimmed = F.trim(sub(F.trim(text), r"\s*\([^)]*$"))
    return let(trimmed, lambda s: let(words_of(s), lambda words: _collapsed(s, words)))


def _collapsed(s: Column, words: Column) -> Column:
    def joined(start, size) -> Column:
        return F.lower(F.array_join(F.slice(words, start, size), " "))

    count = F.size(words)
    halves = F.filter(
        F.sequence(F.greatest(F.floor(count / 2), F.lit(2)).cast("int"), F.lit(2), F.lit(-1)),
        lambda h: joined(F.lit(1), h) == joined(h + 1, h))
    heads = F.filter(
        F.sequence(F.greatest(F.least(F.lit(6), count - 1), F.lit(2)).cast("int"), F.lit(2), F.lit(-1)),
        lambda m: F.startswith(joined(m + 1, count), joined(F.lit(1), m)))
    size = F.coalesce(F.try_element_at(halves, F.lit(1)), F.try_element_at(heads, F.lit(1)))
    twin = F.nullif(F.regexp_extract(squeeze(s), r"(?i)(.{8,200}?)\s*[/|\s]+\s*\1\b", 1), F.lit(""))
    shortened = F.array_join(F.slice(words, F.lit(1), size), " ")
    return F.when(count < 4, s).otherwise(F.coalesce(shortened, F.trim(twin), s))


def clean_consignee(text: Column) -> Column:
    """F16."""
    s = F.replace(F.trim(text), F.lit("|"), F.lit(" "))
    s = sub(s, r"^[\s\-\.:,;#\*]+|[\s\-\.:,;#\*]+$")
    collapsed = collapse_repeat(F.trim(sub(s, r"\s{2,}", " ")))
    return let(collapsed, lambda s: F.when(
        (s != "") & ~is_suffix_only(s) & (F.length(sub(s, "[^A-Za-z]")) >= 3) & (alpha_ratio(s) >= 0.5), s))


def clean_company_line(text: Column) -> Column:
    """one line (or joined lines) of a header block to a company name, NULL when it is not one."""
    return let(sub(strip_chars(text, r" :\-\t"), r"[_\[\]\{\}\|]+", " "),
               lambda s: _company_name(_best_code_part(s), text))


def _best_code_part(s: Column) -> Column:
    parts = F.filter(F.transform(F.split(s, CODE_TOKEN), lambda p: F.trim(p)), lambda p: p != "")
    ranked = F.transform(parts, lambda p, i: F.struct(
        F.when(p.rlike(r"(?i)\b(PVT|PRIVATE|LTD|LIMITED|LLP|COMPANY|TRADING)\b"), 1.0).otherwise(0.0).alias("form"),
        (F.length(sub(p, "[^A-Za-z]")) / F.greatest(F.length(sub(p, r"\s")), F.lit(1))).alias("ratio"),
        word_count(p).alias("words"), (-i).alias("ord"), p.alias("part")))
    return F.when(s.rlike(CODE_TOKEN), F.coalesce(F.array_max(ranked).getField("part"), s)).otherwise(s)


def _company_name(s: Column, text: Column) -> Column:
    s = sub(s, r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}", " ")
    s = sub(s, r"(?i)Recipient\s+Code\s*[:\-]\s*\S+", " ")
    s = sub(s, r"(?is)\s*" + NAME_STOP.removeprefix("(?i)") + r".*$")
    s = sub(s, LEGAL_FORM_PREFIX, "$1")
    s = sub(s, r"(?s)\s+\d.*$")
    s = strip_chars(sub(s, r"\s{2,}", " "), r" ,:\-.")
    s = squeeze(F.translate(F.replace(s, F.lit(".,"), F.lit(".")), ",", " "))
    s = F.trim(sub(s, r" [Il|]$"))
    s = sub(s, r"(?i)\s+(?!CO\b)[A-Z]O\b.*$")
    s = collapse_repeat(s)
    # initials that stood apart in the input stand apart in the result
    initials = F.filter(
        F.transform(hits(text, r"(\b(?:[A-Za-z]\s+)+[A-Za-z]\b)"), lambda q: sub(q, r"\s+")),
        lambda q: F.length(q).between(2, 3))
    s = F.aggregate(initials, s, lambda acc, q: F.call_function(
        "regexp_replace", acc, F.concat(F.lit("(?i)"), q), F.trim(sub(q, "(.)", "$1 "))))
    s = sub(s, r"\b([A-Z])\s+([A-Z])([A-Z])\b", "$1 $2 $3")
    s = sub(s, r"\b([A-Z])([A-Z])\s+([A-Z])\b", "$1 $2 $3")
    s = sub(s, r"\b([A-Z])([A-Z])\s+([A-Z])([A-Z])\b", "$1 $2 $3 $4")
    for wrong, right in COMMON_MISREADS:
        s = sub(s, rf"(?i)\b{wrong}\b", right)
    return F.get(F.filter(F.array(s), lambda v: (
        (F.length(v) >= 3) & (alpha_ratio(v) >= 0.70)
        & ~v.rlike(r"(?U)[^\w\s\-\.\&,\(\)\/]"))), 0)


def simple_cleanup(text: Column) -> Column:
    """keep the wordy tokens of a rejected line, drop codes, lone capitals and repeated words."""
    tokens = F.transform(F.split(sub(F.trim(text), r"[=*_]{2,}", " "), r"[\s,|/\\]+"),
                         lambda t: sub(t, r"^[^A-Za-z]+|[^A-Za-z]+$"))
    kept = F.filter(tokens, lambda t: (t != "") & (~t.rlike(r"\d") | t.rlike("(?i)PVT|LTD|PRIVATE|LIMITED|LLP|INC|CO")))
    joined = strip_chars(sub(F.array_join(kept, " "), r"\s{2,}", " "), r" ,:\-.")
    return let(joined, lambda j: F.when(F.length(sub(j, "[^A-Za-z]")) >= 3, let(words_of(j), _without_codes)))


def _without_codes(parts: Column) -> Column:
    def describes(word: Column) -> Column:
        return F.coalesce(word.rlike("[a-z]") | (F.length(word) > 3), F.lit(False))

    solid = F.filter(parts, lambda p, i: (
        F.upper(p).isin(*SAFE_CAPITALS)
        | (~p.rlike("^[A-Z]{2,4}$") & ~p.rlike(r"^(?:[A-Z]{1,4}[/\\-])+(?:[A-Z]{1,4})$"))
        | (p.rlike("^[A-Z]{2,4}$") & (describes(F.get(parts, i + 1)) | ((i > 0) & describes(F.get(parts, F.greatest(i - 1, F.lit(0)))))))))
    s = sub(F.array_join(solid, " "), r"(?i)\b(\w+)(?:\s+\1\b)+", "$1")
    s = strip_chars(sub(s, r"\s{2,}", " "), r" ,.\-")
    return drop_repeated_run(s)


def drop_repeated_run(text: Column) -> Column:
    """F19, last step: the longest run of 3-8 words that occurs again later loses its first copy."""
    return let(words_of(text), lambda words: _without_run(text, words))


def _without_run(text: Column, words: Column) -> Column:
    count = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(8), F.lit(3), F.lit(-1)), lambda w: F.transform(
        F.when(count >= w, F.sequence(F.lit(0), count - w)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(w.alias("w"), i.alias("i")))))

    def text_of(start: Column, size: Column) -> Column:
        return F.lower(F.array_join(F.slice(words, start, size), " "))

    repeated = F.filter(spans, lambda p: F.contains(
        text_of(p["i"] + p["w"] + 1, count), text_of(p["i"] + 1, p["w"])))
    return F.coalesce(let(F.get(repeated, 0), lambda first: F.array_join(F.concat(
        F.slice(words, F.lit(1), first["i"]), F.slice(words, first["i"] + first["w"] + 1, count)), " ")), text)


def line_for_company_scan(line: Column) -> Column:
    """Trailing marks and a lone last letter go before the name test."""
    return F.trim(sub(F.trim(sub(F.trim(line), r"[\|\\\:\]\[,]+$")), r"\s+[A-Za-z]$"))


def is_salvageable(line: Column) -> Column:
    """Lettered lines that earlier tests rejected for codes or digits, payment terms excluded."""
    return (~line.rlike(FREIGHT_TERMS) & line.rlike("[A-Za-z]")
            & ((alpha_ratio(line) < 0.7) | line.rlike(r"\d{2,}|/")))

