"""Words and sentences of texts, apart from typography, markup and encoding damage."""

from __future__ import annotations

import html
import unicodedata

import regex

_DAMAGE = regex.compile("[ÂÃâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,2}")
_HIDDEN = regex.compile("[­​-‏⁠﻿]")
_TAG = regex.compile(r"</?[A-Za-z][^<>]{0,300}>|<!--.*?-->", regex.S)
_ENTITY = regex.compile(r"&#?\w{1,10};")
_NOTE = regex.compile(r"\[\^?\d{1,4}\]")
_QUOTED = regex.compile(r"^[ \t]*(?:>[ \t]*)+", regex.M)
_WRAPPED = regex.compile(r"(?<=\p{L})-[ \t]*\r?\n[ \t]*(?=\p{Ll})")
_LINK = regex.compile(r"\]\([^()\s]{0,500}\)")
_MARKS = regex.compile(r"\p{M}+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def _mend(m: regex.Match) -> str:
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group()


def clean(text: str) -> str:
    """Text with encoding damage mended and markup, hidden characters, quote marks and line-end hyphens gone."""
    if "Ã" in text or "â" in text or "Â" in text:
        text = _DAMAGE.sub(_mend, text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _QUOTED.sub("", _NOTE.sub("", text))
    return _LINK.sub("]", _WRAPPED.sub("", text))


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return _MARKS.sub("", unicodedata.normalize("NFD", text.casefold()))


def words(text: str) -> list[str]:
    """The folded words of a text; a hyphen parts words."""
    return _WORD.findall(fold(clean(text)))


def joined_words(text: str) -> tuple[list[str], list[int]]:
    """The folded words of a text, and per word the number of the unbroken run of signs it is written in."""
    out, number, k = [], [], 0
    for run in fold(clean(text)).split():
        parts = [run] if run.isalnum() else _WORD.findall(run)
        if parts:
            k += 1
            out += parts
            number += [k] * len(parts)
    return out, number


_END = regex.compile(r"[.!?。！？]+(?=\s|$|[\"')\]»”])|\n[ \t]*(?=\n)|\n[ \t]*(?=[-*•#@>]|\d+[.)]\s)|\|\|")


def sentences(text: str) -> list[str]:
    """Folded sentences of a cleaned text: cut at closing marks, blank lines and list items."""
    return [s for s in _END.split(fold(clean(text))) if s and not s.isspace()]
