"""Roots of Arabic words without a dictionary, by the published method of peeling and pattern templates (ISRI).

Short vowels go, then a prefix and a suffix of two or three letters, then, by the length that is left, a template tells which letters
are the root's. A template is a word form of the grammar's model root: its letters ف ع ل stand for the root's, the others for themselves. Where no template
fits, one letter of the usual endings or beginnings goes and the next length is tried. Words of other scripts stay as they are.
"""

from __future__ import annotations

import functools
import re

# Short vowels and marks, beginnings, endings, word forms and words left alone, as published.
_MARKS = re.compile("[ً-ْ]")
_LONG_PREFIXES = ("كال", "بال", "ولل", "وال", "ال", "لل")
_SUFFIXES = ("تمل", "ون", "ات", "ان", "ين", "تن", "كم", "هن", "نا", "يا", "ها", "تم", "كن", "ني", "وا", "ما", "هم", "همل", "كمل")
_ONE_BEFORE, _ONE_BEHIND = "لبفسويتنا", "ةهيكتان"
_FORMS = {
    4: "مفعل فاعل فعال فعول فعيل فعلة",
    5: "افتعل افاعل مفعال مفعيل مفعول افعلة تفعلة مفعلة مفتعل يفتعل تفتعل مفاعل تفاعل فعالة فعولة انفعل منفعل افعال فعلان تفعيل فاعول فواعل فعائل فاعلة فعالي",
    6: "استفعل مستفعل مفعالة افتعال افعوعل تفاعيل",
}
_FOUR_LETTERS = {5: "تفعلل افعلل مفعلل فعللة فعالل", 6: "؟فعلال متفعلل"}  # roots of four; ؟ is any letter
_LEFT_ALONE = frozenset(
    "يكون وليس وكان كذلك التي وبين عليها مساء الذي وكانت ولكن والتي تكون اليوم اللذين عليه كانت لذلك أمام هناك منها مازال لازال لايزال مايزال اصبح أصبح أمسى امسى أضحى اضحى مابرح مافتئ ماانفك لاسيما ولايزال الحالي اليها الذين فانه والذي وهذا لهذا فكان ستكون اليه يمكن بهذا الذى".split()
)


def _template(form: str) -> re.Pattern:
    out, seen = "", False
    for c in form:
        if c == "ع" and seen:
            out += r"(?P=middle)"
        elif c == "ع":
            out, seen = out + "(?P<middle>.)", True
        else:
            out += "(.)" if c in "فل" else "." if c == "؟" else c
    return re.compile(out, re.S)


@functools.cache
def _templates(four: bool, length: int) -> list[re.Pattern]:
    return [_template(f) for f in (_FOUR_LETTERS if four else _FORMS).get(length, "").split()]


def _root(word: str, four: bool = False) -> str | None:
    for template in _templates(four, len(word)):
        if m := template.fullmatch(word):
            return "".join(m.groups())
    return None


def _shorter(word: str) -> str:
    """Without one letter of the usual endings, else of the usual beginnings."""
    return word[:-1] if word[-1] in _ONE_BEHIND else word[1:] if word[0] in _ONE_BEFORE else word


def isri(word: str) -> str:
    """The root of an Arabic word, or what is left of it where no template fits."""
    w = _MARKS.sub("", word)
    if w in _LEFT_ALONE:
        return w
    if len(w) >= 6:
        w = w[len(next((p for p in _LONG_PREFIXES if w.startswith(p)), "")) :]
    if len(w) >= 6:
        w = w[: len(w) - len(next((s for s in _SUFFIXES if w.endswith(s)), ""))]
    if len(w) >= 4 and w.startswith("وو"):
        w = w[1:]
    if w[:1] in ("آ", "أ", "إ"):
        w = "ا" + w[1:]
    if len(w) == 7:
        w = _shorter(w)
    for length in (6, 5, 4):
        if len(w) == length:
            w = _root(w) or _shorter(w)
            if len(w) == length:  # nothing was found to take off
                return w if length == 4 else _root(w, four=True) or w
    return w
