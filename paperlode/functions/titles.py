"""Titles and headings as Python strings; text.py has the same for columns where both are needed."""

from __future__ import annotations

import hashlib
import re

from ..operators import headings as H

_CJK = "一-鿿"
_PLAIN = re.compile(rf"[^0-9a-zA-Z{_CJK}\s]+")
_MARKS = re.compile(r"\\[A-Za-z]+|[_^{}]")


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _formula(math: re.Match) -> str:
    """What stands between dollars as words; symbols set apart by marks are one word."""
    words = squeeze(_PLAIN.sub(" ", _MARKS.sub(" ", math[1])))
    return re.sub(r"(?<!\S)[0-9A-Za-z](?: [0-9A-Za-z])+(?!\S)", lambda m: m[0].replace(" ", ""), words)


def clean_title(text: str) -> str:
    text = re.sub(r"\$(.+?)\$", _formula, text)
    text = re.sub(r"\(\s*([ivxlcdm]+)\s*\)", r"\1", text, flags=re.IGNORECASE)
    return squeeze(_MARKS.sub(" ", text))


def normal_title(text: str) -> str:
    return squeeze(_PLAIN.sub(" ", clean_title(text).lower()))


def compact(text: str) -> str:
    """By which titles count as the same."""
    return normal_title(text).replace(" ", "")


def document_id(title: str) -> str:
    name = normal_title(title)
    slug = re.sub(r"[^0-9a-z]+", "-", name).strip("-")[:48].strip("-")
    head = hashlib.sha1(name.encode()).hexdigest()[:8]
    return f"{slug}-{head}" if slug else head


def key_of(heading: str) -> str:
    """Lower-case words without numbering; a word whose letters are set apart is joined."""
    words = re.findall(r"[A-Za-z0-9]+", H.NUMBERING.sub("", squeeze(heading).strip(":")))
    spaced = words and all(len(w) == 1 and w.isalpha() for w in words)
    return ("" if spaced else " ").join(words).lower()


def clean_heading(text: str) -> str:
    heading = clean_title(text).strip(":")
    return "Abstract" if key_of(heading) == "abstract" else heading


def variants(a: str, b: str) -> bool:
    """Whether one title is the other with up to four words left out inside."""
    short, long = sorted((normal_title(a).split(), normal_title(b).split()), key=len)
    if len(short) < 6 or short[:4] != long[:4] or short[-1] != long[-1] or len(long) - len(short) > 4:
        return False
    rest = iter(long)
    return all(word in rest for word in short)
