"""Scalar functions as Column builders: they stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"

#: Lower-case Latin letters with marks and their base letters, by rule: what canonical decomposition maps to one ASCII letter.
MARKED = "".join(c for i in range(0xE0, 0x180) if (c := chr(i)).islower() and unicodedata.normalize("NFD", c)[0] in "abcdefghijklmnopqrstuvwxyz" and c not in "abcdefghijklmnopqrstuvwxyz")
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def fold(c: Column | str) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(col(c)), MARKED, PLAIN)


def tokens(c: Column | str) -> Column:
    """Index tokens: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(c: Column | str) -> Column:
    """Tokens of a free-text query: two or more ASCII letters, digits or ideographs, distinct, twelve at most."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(rf"[0-9a-z{CJK}]{{2,}}"), F.lit(0))), 1, 12)


def normalize_for_search(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.lower(col(c)), rf"[^0-9a-z{CJK}\s-]", " "))


def normalize_title(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.lower(clean_title(c)), rf"[^0-9a-z{CJK}\s]", " "))


def clean_title(c: Column | str) -> Column:
    """A title with formulas between dollars as words (symbols set apart by marks are one word), roman numerals without
    parentheses, and no commands or script marks. The same as titles.clean_title, on columns."""
    marks = r"\\[A-Za-z]+|[_^{}]"
    formula = lambda m: F.regexp_replace(collapse(F.regexp_replace(F.regexp_replace(m, marks, " "), rf"[^0-9a-zA-Z{CJK}\s]+", " ")), r"(?<=(?:^|\s)[0-9A-Za-z]) (?=[0-9A-Za-z](?:\s|$))", "")
    between, inside = F.split(col(c), r"\$.+?\$", -1), F.regexp_extract_all(col(c), F.lit(r"\$(.+?)\$"), F.lit(1))
    joined = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.when(i < F.size(inside), formula(F.get(inside, i))).otherwise(F.lit("")))), "")
    plain = F.when(F.contains(col(c), F.lit("$")), joined).otherwise(col(c))
    return collapse(F.regexp_replace(F.regexp_replace(plain, r"(?i)\(\s*([ivxlcdm]+)\s*\)", "$1"), marks, " "))


def query_key(c: Column | str) -> Column:
    """By which queries count as the same."""
    return F.trim(F.regexp_replace(F.lower(col(c)), rf"(?U)[^\w{CJK}]+", " "))


def distinct_words(values: Column) -> Column:
    """An array's strings in order, blanks dropped; equal up to case and punctuation counts once."""
    trimmed = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(trimmed, lambda x: F.regexp_replace(F.lower(x), r"(?U)\W+", ""))
    return F.filter(trimmed, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def constraint_text(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.lower(col(c)), rf"[^0-9a-z{CJK}\s.-]", " "))


def ph_values(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"p\s*h\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))


def contains_cjk(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(f"[{CJK}]"), F.lit(False))


def token_estimate(c: Column | str) -> Column:
    """A quarter token for each ASCII character and one for any other, rounded up, one at least."""
    text = collapse(c)
    other = F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    return F.greatest(F.lit(1), (F.ceil((F.length(text) - other) / 4) + other).cast("int"))


def excerpt(c: Column | str, limit: int = 800) -> Column:
    return F.when(F.length(col(c)) <= limit, col(c)).otherwise(F.concat(F.rtrim(F.substring(col(c), 1, limit - 3)), F.lit("...")))


def present(c: Column | str) -> Column:
    """Null for the empty string."""
    return F.nullif(col(c), F.lit(""))


def document_key(doc_id, source_path, title, chunk_id) -> Column:
    return F.coalesce(present(doc_id), present(source_path), present(title), col(chunk_id))


def make_doc_id(title: Column | str) -> Column:
    """A slug of the normalised title, 48 characters at most, and the head of its SHA-1."""
    name = normalize_title(title)
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(name, "[^0-9a-z]+", "-"), "^-+|-+$", ""), 1, 48), "-+$", "")
    head = F.substring(F.sha1(name.cast("binary")), 1, 8)
    return F.when(slug == "", head).otherwise(F.concat_ws("-", slug, head))


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def short_chunk_id(c: Column | str) -> Column:
    """What stands after the last hyphen of the document's id, with the chunk's number."""
    return F.substring_index(col(c), "-", -1)


def citation(title, page_start, page_end, chunk_id) -> Column:
    pages = F.when(col(page_start) == col(page_end), F.concat(F.lit("p. "), col(page_start).cast("string"))).otherwise(F.concat(F.lit("pp. "), col(page_start).cast("string"), F.lit("-"), col(page_end).cast("string")))
    return F.concat(col(title), F.lit(" ("), pages, F.lit(", chunk "), short_chunk_id(chunk_id), F.lit(")"))


def merged_citation(title, places: Column) -> Column:
    """A title with several places (structs of page_start, page_end, chunk_id)."""
    page = lambda x: F.when(x["page_start"] == x["page_end"], F.concat(F.lit("p. "), x["page_start"].cast("string"))).otherwise(F.concat(F.lit("pp. "), x["page_start"].cast("string"), F.lit("-"), x["page_end"].cast("string")))
    return F.concat(col(title), F.lit(" ("), F.array_join(F.transform(places, lambda x: F.concat(page(x), F.lit(", chunk "), short_chunk_id(x["chunk_id"]))), "; "), F.lit(")"))


def numbered(lines: Column, form: str = "{}. ", between: str = "\n\n") -> Column:
    """An array's lines, each after its number."""
    before, after = form.split("{}")
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after), x)), between)


#: A list number at the start. A point right before a digit is part of a value (3.5 mg, 44.144.126.223).
LIST_NUMBER = r"(?U)^\s*\d+\s*(?:\.(?!\d)|[)、])\s*"


def answer_line(c: Column | str) -> Column:
    """Without a leading list number. The same as citing.answer_line, on columns."""
    return collapse(F.regexp_replace(col(c), LIST_NUMBER, ""))


def json_block(c: Column | str) -> Column:
    """A fenced JSON object, or what stands from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(col(c), r"(?s)\x60{3}json\s*(\{.*?\})\s*\x60{3}", 1)
    bare = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    return F.coalesce(present(fenced), present(bare))


def retry_delay(attempt: Column, base: float = 1.0, limit: float = 8.0) -> Column:
    return F.least(F.lit(limit), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))


def document_numbers(refs: Column, documents: Column) -> Column:
    """For each reference (a place in `documents`, from 1) the number of its document, counted by first appearance in `refs`."""
    named = F.transform(refs, lambda r: F.get(documents, (r - 1).cast("int")))
    distinct = F.array_distinct(named)
    return F.transform(named, lambda d: F.array_position(distinct, d))


def ref_ids(c: Column | str, most: int | Column) -> Column:
    """Numbers inside brackets such as [1] or [8, 82], in order, distinct, from 1 to most."""
    groups = F.regexp_extract_all(col(c), F.lit(r"\[([0-9,\s]+)\]"), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= most)))


def keywords(title, section, text, stop: tuple[str, ...], limit: int = 12) -> Column:
    """A comma-separated hint: words of three or more characters, each once, in order of appearance."""
    source = F.concat_ws(" ", present(title), present(section), F.substring(col(text), 1, 600))
    found = F.regexp_extract_all(source, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]{2,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~F.lower(w).isin(*stop))
    first = F.filter(kept, lambda w, i: F.array_position(F.transform(kept, lambda x: F.lower(x)), F.lower(w)) == i + 1)
    return F.array_join(F.slice(first, 1, limit), ", ")
