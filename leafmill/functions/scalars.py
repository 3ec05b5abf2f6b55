"""Scalar functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A printed part number (three shapes), a resolved-parts line, an ask tag.
PART_NUMBER = r"(?i)\b(?:\d{6,8}|[0-9]{1,3}[A-Z]{1,3}-\d{1,4}[A-Z]?|[A-Z][A-Z0-9]{0,5}(?:-[A-Z0-9]{1,6}){1,8})\b"
RESOLVED = r"Parts shown in this diagram:\s*(.+)"
ASK_TAG = r"(?i)\[ASK:\s*([^\]]+?)\s*\]"
PAST_SECTION = r"(?ims)^#{1,4}\s*Happened before[^\n]*\n.*?(?=^#{1,4}\s|\z)"
LISTING = r"(\[(?:IMAGE|TABLE)_\d+\])[ \t]+(?:DIAGRAM|SCHEMATIC|CHART|FLOWCHART|EXPLODED VIEW|PHOTO|TABLE)\b[^\n]*\(page[^\n]*"
QUANTITY = r"^(\d{1,3}|[xX]|A/R|AR)$"
PLACEHOLDER = r"(?i)^(col(umn)?\s*\d+|-|n/?a)$"
ITEM_CODE = r"^[A-Z]{1,2}\d{1,3}-\d{1,3}$"
DRAWING = r"^[A-Z]{1,3}-{1,2}\d{2,6}$"
#: Abbreviations in part names.
ABBREVIATIONS = {"assy": "assembly", "asm": "assembly", "cyl": "cylinder", "brkt": "bracket", "hdl": "handle", "wshr": "washer", "hsg": "housing", "mtg": "mounting", "adj": "adjuster"}


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Reference form for small inputs; searches use blocks of vectors instead."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clean(c: Column) -> Column:
    """Double hyphens, curly quotes and long dashes made plain, white space collapsed."""
    return collapsed(F.translate(F.replace(c, F.lit("--"), F.lit("-")), "‘’“”–—", "''\"\"--"))


def part_key(c: Column) -> Column:
    """Capital letters and digits, with O as 0 and I as 1."""
    return F.translate(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "OI", "01")


def table_key(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "OIQ", "010")


def lookalike_key(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "ZODQILSBG", "200011586")


def token_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def without_contd(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\s*\(cont'?d\)\s*", " "))


def drawing_family(c: Column) -> Column:
    plain = F.regexp_replace(F.upper(c), r"\s+", "")
    return F.when(F.size(F.split(plain, "-")) > 2, F.regexp_replace(plain, r"-\d{1,2}$", "")).otherwise(plain)


def description_words(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit("([a-z0]{3,})"), F.lit(1)), lambda w: F.translate(w, "0", "o")))


def name_words(c: Column) -> Column:
    """Words of three letters or more, abbreviations spelled out, plural s off."""
    pairs = [F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]
    full = F.create_map(*pairs)

    def word(w: Column) -> Column:
        long = F.coalesce(F.try_element_at(full, w), w)
        return F.when((F.length(long) >= 4) & long.endswith("s") & ~long.endswith("ss"), F.substring(long, F.lit(1), F.length(long) - 1)).otherwise(long)

    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), F.lit(1)), word))


def furniture_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(collapsed(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("--"), F.lit("-"))), r"\d+", "#"))


def part_numbers(c: Column) -> Column:
    """Capital, distinct, sorted; a code without a digit is a plain word."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PART_NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x.rlike(r"\d")), F.upper)))


def resolved_codes(c: Column) -> Column:
    pieces = F.split(F.regexp_extract(F.coalesce(c, F.lit("")), RESOLVED, 1), ";")
    codes = F.transform(pieces, lambda p: F.regexp_replace(F.trim(F.get(F.split(p, "="), F.lit(0))), r"\.+$", ""))
    return F.filter(codes, lambda x: x != "")


def item_code(c: Column) -> Column:
    """Letters O, I, L after the prefix are digits that were misread; NULL if it is no item code."""
    up = F.upper(F.trim(c))
    head = F.regexp_extract(up, r"^([A-Z]{1,2}?)(?=[0-9OIL]{1,3}-)", 1)
    fixed = F.concat(head, F.translate(F.substring(up, F.length(head) + 1, F.length(up)), "OIL", "011"))
    return F.when(fixed.rlike(ITEM_CODE), fixed)


def whole_cells(markdown: Column) -> Column:
    cells = F.transform(F.split(F.coalesce(markdown, F.lit("")), r"[|\n]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(cells, lambda x: (x != "") & (x != "---")))


def without_reasoning(c: Column) -> Column:
    done = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    return blank_to_null(F.regexp_replace(done, r"(?is)<think>.*$", ""))


def without_past_section(c: Column, incidents: Column) -> Column:
    return F.when(incidents == 0, trimmed(F.regexp_replace(c, PAST_SECTION, ""))).otherwise(c)


def without_listing(c: Column) -> Column:
    return F.regexp_replace(c, LISTING, "$1")


def absolute_url(c: Column, host: str) -> Column:
    path = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^data/", "static/")
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(host.rstrip("/") + "/"), F.regexp_replace(path, "^/+", "")))


def chunk_title(c: Column, fallback: Column) -> Column:
    head = trimmed(F.regexp_replace(F.split(trimmed(F.coalesce(c, F.lit(""))), r"\n")[0], "^#+", ""))
    head = F.regexp_replace(F.replace(F.replace(trimmed(F.split(head, r"\(Context:")[0]), F.lit("**"), F.lit("")), F.lit("__"), F.lit("")), r"^[ :*\-]+|[ :*\-]+$", "")
    return F.when(head != "", F.substring(head, 1, 70)).otherwise(fallback)


def session_title(c: Column, query: Column) -> Column:
    first = F.regexp_replace(F.split(trimmed(F.coalesce(c, F.lit(""))), r"\n")[0], "^[\"']+|[\"']+$", "")
    return F.coalesce(F.nullif(F.substring(first, 1, 80), F.lit("")), F.substring(query, 1, 60))


def fallback_summary(symptom: Column, cause: Column, actions: Column, parts: Column) -> Column:
    said = [F.concat(F.lit(f"{label}: "), blank_to_null(c)) for label, c in (("Reported", symptom), ("Cause", cause), ("Fixed by", actions), ("Parts replaced", parts))]
    return F.concat_ws(". ", *said)


def shown_date(c: Column) -> Column:
    """NULL: not recorded; unreadable: the raw text; else day, month, year."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "d MMM yyyy"), c, F.lit("Date not recorded"))


def questions(answer: Column) -> Column:
    """Up to two {question, options} from tags ``[ASK: question | answer | answer]``."""
    bodies = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(ASK_TAG), F.lit(1))

    def one(body: Column) -> Column:
        parts = F.transform(F.split(body, r"\|"), lambda x: F.trim(x))
        options = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda o: F.trim(F.substring(F.regexp_replace(o, r"^[ .]+|[ .]+$", ""), 1, 60)))
        options = F.filter(options, lambda o: o != "")
        lower = F.transform(options, F.lower)
        options = F.filter(options, lambda o, i: F.array_position(lower, F.lower(o)) == i + 1)
        return F.struct(F.substring(parts[0], 1, 200).alias("question"), F.slice(options, 1, 5).alias("options"))

    return F.slice(F.filter(F.transform(bodies, one), lambda q: (q["question"] != "") & (F.size(q["options"]) >= 2)), 1, 2)


def without_questions(answer: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(answer, ASK_TAG, ""), r"\n{3,}", "\n\n"))


#: Fixed value: the flag that a question about a machine without a manual carries.
NO_MANUAL = "[DISCLAIMER_REQUIRED: MISSING_MANUAL]"
CJK = "[㐀-鿿]"


def without_manual_flag(query: Column) -> Column:
    """The question as it is searched with."""
    return trimmed(F.replace(query, F.lit(NO_MANUAL), F.lit("")))


def with_manual_flag(query: Column, n_chunks: Column) -> Column:
    """The question, marked when the manual has no chunks to answer it from."""
    return F.when(F.coalesce(n_chunks, F.lit(0)) > 0, query).otherwise(F.concat(F.lit(NO_MANUAL + " "), query))


def tail(c: Column, n: int) -> Column:
    """The last n characters."""
    return F.when(F.char_length(c) > n, F.right(c, F.lit(n))).otherwise(c)


def memory_text(symptom: Column, cause: Column, fix: Column, summary: Column) -> Column:
    """What a past fix is embedded by: its lines that are not blank."""
    return F.concat_ws("\n", *map(blank_to_null, (symptom, cause, fix, summary)))


def json_list(c: Column, kind: str = "array<string>") -> Column:
    """A stored JSON list; nothing stored, or nothing that can be read, is an empty one."""
    return F.coalesce(F.from_json(c, kind), F.array().cast(kind))


def json_or_null(c: Column) -> Column:
    """A list as it is stored: an empty one is NULL."""
    return F.when(F.size(c) > 0, F.to_json(c))


def timestamp_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def needs_translation(c: Column) -> Column:
    return F.coalesce(c.rlike(CJK), F.lit(False))


def shown_answer(answer: Column) -> Column:
    """An answer as it is shown, {phase, body}: suggestion and question tags go, a phase tag at its beginning is named apart."""
    plain = trimmed(F.regexp_replace(answer, r"(?i)\[SUGGESTION:[^\]]*\]|\[ASK:[^\]]*\]", ""))
    tag = r"(?i)^\s*\[PHASE:\s*([^\]]+)\]\s*"
    return F.struct(F.when(plain.rlike(tag), F.trim(F.regexp_extract(plain, tag, 1))).alias("phase"), F.regexp_replace(plain, tag, "").alias("body"))


def solves(option: Column) -> Column:
    """Whether choosing this answer says that the fault is gone."""
    return F.coalesce(option.rlike("(?i)^problem solved"), F.lit(False))


def chosen_answer(question: Column, option: Column) -> Column:
    """What is sent when an option is chosen."""
    return F.concat(question, F.lit(" — "), option)


def diagnosis_queries(report: Column, symptoms: Column, components: Column, codes: Column) -> Column:
    """The questions that a fault report is looked up with: itself, then up to four symptoms, four components
    and three fault codes that were read from it, each once whatever its case.  A NULL list has none."""
    some = lambda c, n: F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), trimmed), lambda x: F.coalesce(x, F.lit("")) != ""), 1, n)
    asked = F.concat(
        F.array(report), F.transform(some(symptoms, 4), lambda x: F.concat(x, F.lit(" cause troubleshooting"))), some(components, 4),
        F.transform(some(codes, 3), lambda x: F.concat(F.lit("fault code "), x)),
    )
    lower = F.transform(asked, F.lower)
    return F.filter(asked, lambda q, i: F.array_position(lower, F.lower(q)) == i + 1)
