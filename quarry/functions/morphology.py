"""English forms of a word, by rule."""

from __future__ import annotations

#: Irregular forms that rules don't reach.
IRREGULAR = (
    ("be", "am", "are", "is", "was", "were", "been", "being"), ("have", "has", "had", "having"), ("do", "does", "did", "done", "doing"), ("go", "goes", "went", "gone", "going"),
    ("make", "makes", "made", "making"), ("take", "takes", "took", "taken", "taking"), ("run", "runs", "ran", "running"), ("see", "sees", "saw", "seen", "seeing"),
    ("write", "writes", "wrote", "written", "writing"), ("give", "gives", "gave", "given", "giving"), ("child", "children"), ("man", "men"), ("woman", "women"), ("foot", "feet"), ("tooth", "teeth"), ("mouse", "mice"), ("person", "people"),
)


def _base(word: str) -> set[str]:
    out = {word}
    for ending, back in (("ies", "y"), ("ied", "y"), ("es", ""), ("es", "e"), ("s", ""), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("er", ""), ("er", "e"), ("est", ""), ("est", "e"), ("ly", ""), ("ness", ""), ("ment", ""), ("ation", "e"), ("ation", "")):
        if word.endswith(ending) and len(word) - len(ending) > 2:
            stem = word[: -len(ending)] + back
            out.add(stem)
            if not back and len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "ls":
                out.add(stem[:-1])
    return out


def variations(word: str) -> set[str]:
    """The word with its plural, verb, comparison and derived forms."""
    out = {word}
    for group in IRREGULAR:
        if word in group:
            out |= set(group)
    for base in _base(word):
        if len(base) < 3:
            continue
        out.add(base)
        if base.endswith("e"):
            out |= {base + x for x in ("s", "d", "r", "st", "ly", "ment")} | {base[:-1] + x for x in ("ing", "ation", "ations", "able", "er", "ers")}
        elif base.endswith("y") and base[-2] not in "aeiou":
            out |= {base[:-1] + x for x in ("ies", "ied", "ier", "iest", "ily", "iness")} | {base + "ing"}
        else:
            ends = "es" if base.endswith(("s", "x", "z", "ch", "sh")) else "s"
            out |= {base + x for x in (ends, "ed", "ing", "er", "ers", "est", "ly", "ness", "ment", "able")}
            if len(base) > 2 and base[-1] in "bdgklmnprt" and base[-2] in "aeiou" and base[-3] not in "aeiou":
                out |= {base + base[-1] + x for x in ("ed", "ing", "er", "ers")}
    return out
