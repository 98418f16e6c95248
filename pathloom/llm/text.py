"""Words of texts with wiki or HTML markup."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?(?:[a-zA-Z][^<>]*)>")
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|small|big|sub|sup|span|font|tt|code|mark|abbr)(?:\s[^<>]*)?/?>", re.I)
_LINK = re.compile(r"\[\[[^\[\]|\n]*\|")
_URL = re.compile(r"\[?\bhttps?://[^\s\]|}<>\"]+")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]+")
_QUOTES = re.compile("''+")
_MARKS = re.compile("[̀-ͯ]+")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """``text`` in lower case without markup, entities, accents and invisible characters. What templates, comments, tables and
    references hold stays, as it is part of the text; of a link the label stays."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "[[" in text:
        text = _LINK.sub("", text).replace("[[", "").replace("]]", "")
    if "http" in text:
        text = _URL.sub(" ", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("ß", "ss")
    return text


def words(text: str) -> list[str]:
    """The words of :func:`plain`: runs of letters and digits."""
    return _WORD.findall(plain(text))


def spaced_words(text: str) -> list[list[str]]:
    """The words between spaces, each with the runs of letters and digits it consists of ("l'eau" has two)."""
    return [w for w in (_WORD.findall(x) for x in plain(text).split()) if w]
