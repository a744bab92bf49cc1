"""What text operators leave out of account: invisible characters, entities and mark-up."""

from __future__ import annotations

import html
import re
import unicodedata

#: Characters without shape (soft hyphens, zero-width signs, direction
#: marks, variation selectors).
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
# no length bound: the scan stops at the next angle, so it is linear
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def plain(text: str) -> str:
    """The text with entities resolved, in compatibility form, without invisible characters."""
    t = html.unescape(text) if "&" in text else text
    return t if t.isascii() else unicodedata.normalize("NFKC", INVISIBLE.sub("", t))


def _without_comments(t: str, by: str) -> str:
    out, at = [], 0
    while (a := t.find("<!--", at)) >= 0 and (b := t.find("-->", a + 4)) >= 0:
        out += [t[at:a], by]
        at = b + 3
    return "".join(out) + t[at:] if out else t


def without_tags(t: str, by: str = " ") -> str:
    """The text with each tag and comment, of any length, replaced; a comment that isn't closed stays."""
    if "<" not in t:
        return t
    return _TAG.sub(by, _without_comments(t, by))
