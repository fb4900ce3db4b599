"""What a heading or a paragraph of a paper is, by its own text."""

from __future__ import annotations

import re

from ..functions.titles import key_of, squeeze
from . import headings as H


def _has(text: str, parts) -> bool:
    return any(p in text for p in parts)


def is_tail(heading: str) -> bool:
    key = key_of(heading)
    return key in H.TAIL or key.startswith("received ")


def is_dropped(heading: str) -> bool:
    return key_of(heading) in H.DROPPED


def is_section(heading: str) -> bool:
    key = key_of(heading)
    if is_tail(heading) or key in H.DROPPED:
        return False
    return key in H.SECTIONS | H.SUMMARY or bool(H.NUMBERING.match(squeeze(heading)))


def is_banner(heading: str) -> bool:
    """Four or more capitals, each set apart."""
    letters = re.sub(r"[^A-Za-z]+", "", heading)
    runs = re.findall(r"[A-Z]+", heading)
    return bool(letters) and letters.isupper() and len(runs) >= 4 and max(map(len, runs)) == 1


def is_masthead(heading: str) -> bool:
    text = squeeze(heading)
    low = text.lower()
    if low.startswith(("journal of ", "a journal of ")) or "gesellschaft deutscher chemiker" in low:
        return True
    if "angewandte" in low and "chemie" in low and len(text) <= 120:
        return True
    words = " ".join(re.findall(r"[A-Za-z0-9]+", text)).lower()
    return key_of(text) in H.MASTHEADS or (text.istitle() and words in H.MASTHEAD_WORDS)


def is_authors(text: str) -> bool:
    """A list of three or more names, or fewer with a form of address."""
    low = text.lower()
    if len(text) > 500 or ":" in text or _has(low, H.NOT_NAMES):
        return False
    pieces = [p for p in map(str.strip, re.split(r"[,*†‡§]+", re.sub(r"\s+and\s+", ", ", text))) if p]
    addressed = _has(low, H.HONORIFICS)

    def name(piece: str) -> bool:
        words = re.findall(r"[A-Za-z][A-Za-z'\-]+", piece)
        return 0 < len(words) <= 5 and sum(w[0].isupper() for w in words) >= max(1, len(words) - 1)

    names = sum(map(name, pieces))
    return names >= 2 if addressed else len(pieces) >= 3 and names >= max(3, len(pieces) // 2)


def is_author_heading(heading: str) -> bool:
    return is_authors(re.sub(r"^\s*Q\d+\s+", "", squeeze(heading)))


def never_title(heading: str) -> bool:
    """A level-1 heading that cannot be a paper's title, whatever follows it."""
    key = key_of(heading)
    listed = key in H.SUMMARY | H.NOT_TITLES | H.PAGE_HEADINGS or key.startswith("theme ")
    shaped = is_masthead(heading) or is_author_heading(heading) or is_banner(squeeze(heading)) or bool(H.CONFERENCE.fullmatch(squeeze(heading)))
    return listed or shaped or is_tail(heading) or is_dropped(heading) or is_section(heading)


def is_label(text: str) -> bool:
    return bool(H.LABEL.fullmatch(squeeze(text).lower()))


def is_place(text: str) -> bool:
    low = text.lower()
    places = sum(p in low for p in H.PLACES)
    if H.EMAIL.search(text):
        return True
    if places:
        return len(text) <= 500 or places > 1
    return len(text) <= 120 and (_has(low, H.COUNTRIES) or bool(re.search(r"\b\d{4,6}\b", text)))


def is_metadata(text: str) -> bool:
    return bool(H.METADATA_START.match(text) or H.LINK.fullmatch(text.strip())) or key_of(text) in H.PAGE_HEADINGS or _has(text.lower(), H.METADATA)


def is_noise(text: str) -> bool:
    """Labels, author lists, affiliations and publishers' notes."""
    return is_label(text) or is_authors(text) or is_place(text) or is_metadata(text)


def is_caption(text: str) -> bool:
    return bool(H.CAPTION.match(squeeze(text)))


def caption_goes_on(text: str) -> bool:
    low = squeeze(text).lower()
    return bool(H.CAPTION_GOES_ON.match(low)) or _has(low, H.CAPTION_WORDS) or low.startswith("movie available")


def is_table(text: str) -> bool:
    line = squeeze(text)
    low = line.lower()
    if low.startswith(("<table", "</table")) or _has(low, H.TABLE_TAGS):
        return True
    return (line.startswith("|") and line.count("|") > 1) or ("|" in line and bool(re.fullmatch(r"[\s:\-|]+", line)))


def is_diagram(text: str) -> bool:
    low = text.lower()
    return "<details" in low or "```mermaid" in low or low.startswith("graph td") or text.count("-->") > 2


def opens_details(text: str) -> bool:
    low = text.lower()
    return "<details" in low and "</details>" not in low


def visible(text: str) -> str:
    """Without folded details and diagrams; what only counts or numbers a figure is nothing."""
    if not _has(text.lower(), ("<details", "```mermaid")):
        return text
    rest = squeeze(re.sub(r"(?i)<details\b.*?</details>|```mermaid.*?```", " ", text))
    rest = re.sub(r"(?i)^(?:a total of|the following)\s+", "", rest)
    return "" if H.FIGURE_NUMBER.fullmatch(rest) else rest


def is_substantial(text: str) -> bool:
    return len(re.findall(r"\b\w+\b", text)) >= H.PROSE_WORDS or len(text) >= H.PROSE_CHARS


def is_sentence(text: str) -> bool:
    return bool(re.search(r"[.!?;:]", text))


def is_prose(text: str) -> bool:
    return is_substantial(text) and is_sentence(text)


def ends_sentence(text: str) -> bool:
    return bool(H.SENTENCE_END.search(squeeze(text)))


def is_inline_abstract(text: str) -> bool:
    return bool(re.match(r"\s*abstract\s*[:：]", text, re.IGNORECASE))
