"""Phonetic codes."""

from __future__ import annotations

import functools
import re

#: Sound classes of English, Spanish and Arabic letters.
EN = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}
ES = {c: d for d, cs in {"1": "bpv", "2": "fh", "3": "dt", "4": "szcx", "5": "yjllñ", "6": "nm", "7": "qkg", "8": "r"}.items() for c in cs}
AR = {c: d for d, cs in {"1": "فب", "2": "خجزسصظقكغش", "3": "تثدذضطة", "4": "ل", "5": "من", "6": "ر"}.items() for c in cs}


def _code(word: str, classes: dict[str, str]) -> str:
    """Classes of the letters in turn, runs of one class once, letters without class left out."""
    out, last = "", ""
    for ch in word:
        d = classes.get(ch, "")
        if d and d != last:
            out += d
        last = d
    return out


def soundex_en(word: str) -> str:
    """First letter and classes of the rest; neither padded nor cut to four."""
    w = word.lower()
    if not w:
        return ""
    code = _code(w, EN)
    return w[0] + (code[1:] if EN.get(w[0]) else code)


def soundex_es(word: str) -> str:
    return _code(word.lower(), ES)


def soundex_ar(word: str) -> str:
    return "0" + _code(word[1:], AR) if word else ""


#: Double Metaphone after Philips' description, as rules of one letter each: what the word looks like from that letter on (and
#: behind it), the sounds in the primary and secondary code, and what must hold of the whole word. The first rule that fits
#: gives the sounds and uses up what its pattern matches; @ stands for the vowels.
_RULES = """
A EIOUY  ^.                                            A
A EIOUY  .                                             -
B        BB?                                           P
Ç        .                                             S
C        (?<=[^@]A)CH(?![IE])|(?<=[BM]A)CH(?=ER)       K
C        ^CA(?=ESAR)                                   S
C        CH(?=IA)                                      K
C        (?<=.)CH(?=AE)                                K  X
C        ^(?!CHORE)CH(?=ARAC|ARIS|OR|YM|IA|EM)         K
C        CH                                            K  K  germanic
C        (?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)|CH(?=[TS]) K
C        (?:^|(?<=[AOUE]))CH(?=[LRNMBHFVW_]|$)         K
C        (?<=.)CH                                      K  K  mc
C        (?<=.)CH                                      X  K
C        CH                                            X
C        (?<!WI)CZ                                     S  X
C        CCI(?=A)                                      X
C        (?<=^A)CC(?:[IE]|H(?!U))|(?<=U)CCE(?=[ES])    KS
C        (?<!^M)CC(?:[IE]|H(?!U))                      X
C        (?<!^M)CC|C[KGQ]                              K
C        CI(?=[OEA])                                   S  X
C        C[IEY]                                        S
C        C_[CQG]|CC(?![EI])|C                          K
D        DG[IEY]                                       J
D        DG                                            TK
D        D[TD]?                                        T
F        FF?                                           F
G        (?<=[^@])GH                                   K
G        ^GH(?=I)                                      J
G        ^GH                                           K
G        (?<=^.)G(?=H)                                 A
G        (?<=^..)G(?=H)                                -
G        (?:(?<=[BHD].)|(?<=[BHD]..)|(?<=[BH]...))GH   -
G        (?<=[CGLRT].U)GH                              F
G        (?<=[^I])GH                                   K
G        GH                                            -
G        (?<=^[@])GN                                   KN N  !slavic
G        GN(?!EY)                                      N  KN !slavic
G        GN                                            KN
G        GL(?=I)                                       KL L  !slavic
G        ^G(?:Y|E(?=[SPBLYIR])|I(?=[BLNE]))            K  J
G        (?<![EIRO])GY                                 K  J  !anger
G        G[EIY]|(?<=[AO])GG(?=I)                       K  K  germanic
G        GE(?=T)                                       K
G        GI(?=ER(?:_|$))                               J
G        G[EIY]|(?<=[AO])GG(?=I)                       J  K
G        GG?                                           K
H        (?:^|(?<=[@]))H[@]                            H
H        H                                             -
J        ^J(?=OSE(?:_|$))                              H
J        JJ?                                           H  H  san
J        J(?=OSE)                                      J  H
J        ^JJ?                                          J  A
J        (?<=[@])J(?=[AO])                             J  H  !slavic
J        J$                                            J  _
J        (?<![SKL])J(?![LTKSNMBZ])J?                   J
J        JJ?                                           -
K        KK?                                           K
L        (?<=I)LL(?=[OA]$)|(?<=A)LL(?=E$)              L  -
L        (?<=A)LL(?=E.*[AO]S?$)                        L  -
L        LL?                                           L
M        MM?                                           M
N        NN?                                           N
Ñ        .                                             N
P        PH                                            F
P        P[PB]?                                        P
Q        QQ?                                           K
R        (?<=IE)(?<!MEIE)(?<!MAIE)R$                   -  R  !slavic
R        RR?                                           R
S        (?<=[IY])S(?=L)                               -
S        ^S(?=UGAR)                                    X  S
S        SH(?=EIM|OEK|OLM|OLZ)                         S
S        SH                                            X
S        SI[OA]                                        S  X  !slavic
S        SI[OA]                                        S
S        ^S(?=[MNLW])|SZ                               S  X
S        SCH(?=E[RN])                                  X  SK
S        SCH(?=OO|UY|ED|EM)                            SK
S        ^SCH(?![@W])                                  X  S
S        SCH                                           X
S        SC[IEY]                                       S
S        SC.?                                          SK
S        (?<=[AO]I)S$                                  -  S
S        S[SZ]?                                        S
T        TIO(?=N)|TIA|TCH                              X
T        TH(?=[OA]M)                                   T
T        TH|TT(?=H)                                    T  T  germanic
T        TH|TT(?=H)                                    0  T
T        T[TD]?                                        T
V        VV?                                           F
W        WR                                            R
W        ^W(?=[@])                                     A  F
W        ^W(?=H)                                       A
W        (?<=[@])W$|(?<=[EO])W(?=SK[IY])               -  F
W        W                                             -  F  sch
W        WI[CT]Z                                       TS FX
W        W                                             -
X        (?:(?<=[IE]AU)|(?<=[AO]U))X$                  -
X        X[CX]?                                        KS
Z        ZH                                            J
Z        ZZ(?=[OIA])                                   S  TS
Z        (?<=[^T])ZZ?                                  S  TS slavic
Z        ZZ?                                           S
"""
_WHOLE = {"slavic": re.compile("W|K|CZ"), "germanic": re.compile("^(?:V[AO]N |SCH)"), "sch": re.compile("^SCH"), "mc": re.compile("^MC"), "san": re.compile("^SAN "), "anger": re.compile("^[DRM]ANGER")}
_SILENT = re.compile("GN|KN|PN|WR|PS")


@functools.cache
def _rules() -> dict[str, list[tuple[re.Pattern, str, str, str]]]:
    """The rules by letter: pattern, primary sounds, secondary sounds, condition."""
    out: dict[str, list[tuple[re.Pattern, str, str, str]]] = {}
    for line in _RULES.strip().splitlines():
        m = re.fullmatch(r"(.) (\w*) *(\S+) +(\S+) *(\S*) *(\S*)", line)
        pattern = re.compile(m[3].replace("@", "AEIOUY").replace("_", " "), re.S)
        first = m[4].strip("-")
        second = m[5].replace("_", " ").strip("-") if m[5] else first
        for letter in m[1] + m[2]:
            out.setdefault(letter, []).append((pattern, first, second, m[6]))
    return out


def double_metaphone(text: str) -> tuple[str, str]:
    """Primary and secondary code of a word; the secondary is empty if it is the same."""
    word = text.upper()
    known, rules = {name: bool(p.search(word)) for name, p in _WHOLE.items()}, _rules()
    first, second, at = "", "", 1 if _SILENT.match(word) else 0
    while at < len(word):
        step = 1
        for pattern, a, b, condition in rules.get(word[at], ()):
            if condition and known[condition.lstrip("!")] == condition.startswith("!"):
                continue
            if m := pattern.match(word, at):
                first, second, step = first + a, second + b, m.end() - at
                break
        at += step
    return first, "" if second == first else second
