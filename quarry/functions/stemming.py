"""Stemmers, from their published descriptions.

Rule tables with a small engine for the Snowball family: regions R1, R2 and RV, longest suffix first.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

from quarry.functions.arabic import isri


def _longest(word: str, suffixes: Iterable[str], start: int = 0) -> str | None:
    """The longest of the suffixes that ends the word within word[start:]."""
    best = None
    for s in suffixes:
        if word.endswith(s) and len(word) - len(s) >= start and (best is None or len(s) > len(best)):
            best = s
    return best


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for k in range(start + 1, len(word)):
        if word[k] not in vowels and word[k - 1] in vowels:
            return k + 1
    return len(word)


# Porter


_CONSONANT = "[^aeiou]"
_C, _V = "(?:[^aeiouy]|(?<![^aeiou])y|^y)", "(?:[aeiou]|(?<=[^aeiou])y)"


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Porter's algorithm of 1980."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    elif (s := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(s)]):
        w, again = w[: -len(s)], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s in ("sion", "tion"):
        s = "ion"
    if s and _measure(w[: -len(s)]) > 1:
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# Porter 2 (Snowball English)

_E2 = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_E2_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_E2_STOP = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_E2_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_E2_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_E2_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def porter2(word: str) -> str:
    """The English stemmer of the Snowball family."""
    w = word.lower().lstrip("'")
    if len(w) <= 2:
        return w
    if w in _E2 or w in _E2_SAME:
        return _E2.get(w, w)
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    v = "aeiouy"
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else _region(w, v)
    r2 = _region(w, v, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(f"[{v}].", w[:-1]):
        w = w[:-1]
    if w in _E2_STOP:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(f"[{v}]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    s = _longest(w, _E2_STEP2)
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif s == "li":
            w = w[:-2] if w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(s)] + _E2_STEP2[s]
    s = _longest(w, _E2_STEP3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + _E2_STEP3[s]
    s = _longest(w, _E2_STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


# Scandinavian


def _scandinavian(word: str, vowels: str, steps: Callable[[str, int], str]) -> str:
    w = word.lower()
    return steps(w, max(_region(w, vowels), 3))


def swedish(word: str) -> str:
    def steps(w: str, r1: int) -> str:
        s = _longest(w, "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s".split(), r1)
        if s and (s != "s" or w[-2] in "bcdfghjklmnoprtvy"):
            w = w[: -len(s)]
        if _longest(w, "dd gd nn dt gt kt tt".split(), r1):
            w = w[:-1]
        s = _longest(w, "lig ig els löst fullt".split(), r1)
        return w[:-1] if s in ("löst", "fullt") else w[: -len(s)] if s else w

    return _scandinavian(word, "aeiouyäåö", steps)


def norwegian(word: str) -> str:
    def steps(w: str, r1: int) -> str:
        s = _longest(w, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast erte ert s".split(), r1)
        if s in ("erte", "ert"):
            w = w[: -len(s)] + "er"
        elif s and (s != "s" or w[-2] in "bcdfghjlmnoprtvyz" or w[-2] == "k" and w[-3] not in "aeiouyæåø"):
            w = w[: -len(s)]
        if _longest(w, ("dt", "vt"), r1):
            w = w[:-1]
        s = _longest(w, "leg eleg ig eig lig elig els lov elov slov hetslov".split(), r1)
        return w[: -len(s)] if s else w

    return _scandinavian(word, "aeiouyæåø", steps)


def danish(word: str) -> str:
    def steps(w: str, r1: int) -> str:
        def undo(w: str) -> str:
            return w[:-1] if _longest(w, "gd dt gt kt".split(), r1) else w

        s = _longest(w, "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s".split(), r1)
        if s and (s != "s" or w[-2] in "abcdfghjklmnoprtvyzå"):
            w = w[: -len(s)]
        w = undo(w)
        if w.endswith("igst"):
            w = w[:-2]
        s = _longest(w, "ig lig elig els løst".split(), r1)
        if s == "løst":
            w = w[:-1]
        elif s:
            w = undo(w[: -len(s)])
        if len(w) > r1 and w[-1] == w[-2] and w[-1] not in "aeiouyæåø":
            w = w[:-1]
        return w

    return _scandinavian(word, "aeiouyæåø", steps)


# German, Dutch


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.lower().replace("ß", "ss")
    w = re.sub(f"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), w)
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    r1 = max(r1, 3)
    s = _longest(w, "em ern er e en es s".split(), r1)
    if s and (s != "s" or w[-2] in "bdfghklmnrt"):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, "en er est st".split(), r1)
    if s and (s != "st" or w[-3] in "bdfghklmnt" and len(w) > 5):
        w = w[: -len(s)]
    s = _longest(w, "end ung ig ik isch lich heit keit".split(), r2)
    if s in ("end", "ung"):
        w = w[:-3]
        if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
            w = w[:-2]
    elif s in ("ig", "ik", "isch"):
        if not w[: -len(s)].endswith("e"):
            w = w[: -len(s)]
    elif s in ("lich", "heit"):
        w = w[:-4]
        if t := _longest(w, ("er", "en"), r1):
            w = w[: -len(t)]
    elif s == "keit":
        w = w[:-4]
        if t := _longest(w, ("lich", "ig"), r2):
            w = w[: -len(t)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


def dutch(word: str) -> str:
    v = "aeiouyè"
    w = word.lower().translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(f"^y|(?<=[{v}])y|(?<=[{v}])i(?=[{v}])", lambda m: m[0].upper(), w)
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    r1 = max(r1, 3)

    def single(w: str) -> str:
        return w[:-1] if w.endswith(("kk", "dd", "tt")) else w

    s = _longest(w, "heden ene en se s".split(), r1)
    if s == "heden":
        w = w[:-5] + "heid"
    elif s in ("ene", "en"):
        if w[: -len(s)][-1:] not in v and not w[: -len(s)].endswith("gem"):
            w = single(w[: -len(s)])
    elif s and w[: -len(s)][-1:] not in v + "j":
        w = w[: -len(s)]
    removed = w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] not in v
    if removed:
        w = single(w[:-1])
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5:-4] != "c":
        w = w[:-4]
        if w.endswith("en") and len(w) - 2 >= r1 and w[-3:-2] not in v and not w.endswith("gemen"):
            w = single(w[:-2])
    s = _longest(w, "end ing ig lijk baar bar".split(), r2)
    if s in ("end", "ing"):
        w = w[:-3]
        if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
            w = w[:-2]
        else:
            w = single(w)
    elif s == "ig":
        w = w if w.endswith("eig") else w[:-2]
    elif s == "lijk":
        w = w[:-4]
        if w.endswith("e") and len(w) - 1 >= r1 and w[-2:-1] not in v:
            w = single(w[:-1])
    elif s == "baar" or s == "bar" and removed:
        w = w[: -len(s)]
    if re.search(r"[^aeiouyèI](aa|ee|oo|uu)[^aeiouyèI]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


# Romance


def _rv(w: str, v: str) -> int:
    if len(w) > 1 and w[1] not in v:
        k = next((k for k in range(2, len(w)) if w[k] in v), len(w))
        return k + 1
    if len(w) > 1 and w[0] in v and w[1] in v:
        k = next((k for k in range(2, len(w)) if w[k] not in v), len(w))
        return k + 1
    return min(3, len(w))


def spanish(word: str) -> str:
    v = "aeiouáéíóúü"
    plain = str.maketrans("áéíóú", "aeiou")
    w = word.lower()
    rv, r1 = _rv(w, v), _region(w, v)
    r2 = _region(w, v, r1)
    s = _longest(w, "me se sela selo selas selos la le lo las les los nos".split(), rv)
    if s:
        stem = w[: -len(s)]
        t = _longest(stem, "iéndo ándo ár ér ír ando iendo ar er ir yendo".split(), rv)
        if t and (t != "yendo" or stem.endswith("uyendo")):
            w = stem[: -len(t)] + t.translate(plain)
    was = w
    groups = {
        "": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
        "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion".split(),
        "log": "logía logías".split(),
        "u": "ución uciones".split(),
        "ente": "encia encias".split(),
        "amente": ["amente"],
        "mente": ["mente"],
        "idad": "idad idades".split(),
        "iva": "iva ivo ivas ivos".split(),
    }
    s = _longest(w, [x for g in groups.values() for x in g])
    kind = next((k for k, g in groups.items() if s in g), None)
    if s and len(w) - len(s) >= (r1 if kind == "amente" else r2):
        w = w[: -len(s)]
        if kind in ("log", "u", "ente"):
            w += kind
        elif kind == "ic" and w.endswith("ic") and len(w) - 2 >= r2:
            w = w[:-2]
        elif kind == "amente":
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            elif t := _longest(w, ("os", "ic", "ad"), r2):
                w = w[: -len(t)]
        elif kind == "mente" and (t := _longest(w, ("ante", "able", "ible"), r2)):
            w = w[: -len(t)]
        elif kind == "idad" and (t := _longest(w, ("abil", "ic", "iv"), r2)):
            w = w[: -len(t)]
        elif kind == "iva" and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
    if w == was:
        s = _longest(w, "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split(), rv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            drop = "en es éis emos".split()
            other = "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
            s = _longest(w, drop + other, rv)
            if s in drop:
                w = w[: -len(s)]
                if w.endswith("gu"):
                    w = w[:-1]
            elif s:
                w = w[: -len(s)]
    s = _longest(w, "os a o á í ó e é".split(), rv)
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


def italian(word: str) -> str:
    v = "aeiouàèìòù"
    w = word.lower().translate(str.maketrans("áéíóú", "àèìòù"))
    w = re.sub("qu", "qU", w)
    w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), w)
    rv, r1 = _rv(w, v), _region(w, v)
    r2 = _region(w, v, r1)
    s = _longest(w, "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split(), rv)
    if s:
        stem = w[: -len(s)]
        if _longest(stem, ("ando", "endo"), rv):
            w = stem
        elif _longest(stem, ("ar", "er", "ir"), rv):
            w = stem + "e"
    was = w
    first = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
    ations = "azione azioni atore atori".split()
    logy, ution, enza, ment = "logia logie".split(), "uzione uzioni usione usioni".split(), "enza enze".split(), "amento amenti imento imenti".split()
    ity, ive = ["ità"], "ivo ivi iva ive".split()
    s = _longest(w, [*first, *ations, *logy, *ution, *enza, *ment, *ity, *ive, "amente"])
    if s:
        limit = rv if s in ment else r1 if s == "amente" else r2
        if len(w) - len(s) >= limit:
            w = w[: -len(s)]
            if s in ations and w.endswith("ic") and len(w) - 2 >= r2:
                w = w[:-2]
            elif s in logy:
                w += "log"
            elif s in ution:
                w += "u"
            elif s in enza:
                w += "ente"
            elif s == "amente":
                if w.endswith("iv") and len(w) - 2 >= r2:
                    w = w[:-2]
                    if w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
                elif t := _longest(w, ("abil", "os", "ic"), r2):
                    w = w[: -len(t)]
            elif s in ity and (t := _longest(w, ("abil", "ic", "iv"), r2)):
                w = w[: -len(t)]
            elif s in ive and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("ic") and len(w) - 2 >= r2:
                    w = w[:-2]
    if w == was:
        s = _longest(w, "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir".split(), rv)
        if s:
            w = w[: -len(s)]
    if len(w) - 1 >= rv and w[-1:] in tuple("aeioàèìò"):
        w = w[:-1]
        if len(w) - 1 >= rv and w.endswith("i"):
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w.lower()


def portuguese(word: str) -> str:
    v = "aeiouáéíóúâêô"
    w = word.lower().replace("ã", "a~").replace("õ", "o~")
    rv, r1 = _rv(w, v), _region(w, v)
    r2 = _region(w, v, r1)
    was = w
    first = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
    more = {"logia": "log", "logias": "log", "ução": "u", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
    s = _longest(w, [*first, *more, "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"])
    if s and len(w) - len(s) >= (r1 if s == "amente" else rv if s in ("ira", "iras") else r2):
        stem = w[: -len(s)]
        if s in ("ira", "iras"):
            w = stem + "ir" if stem.endswith("e") else w
        elif s in more:
            w = stem + more[s]
        else:
            w = stem
            if s == "amente":
                if w.endswith("iv") and len(w) - 2 >= r2:
                    w = w[:-2]
                    if w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
                elif t := _longest(w, ("os", "ic", "ad"), r2):
                    w = w[: -len(t)]
            elif s == "mente" and (t := _longest(w, ("ante", "avel", "ível"), r2)):
                w = w[: -len(t)]
            elif s in ("idade", "idades") and (t := _longest(w, ("abil", "ic", "iv"), r2)):
                w = w[: -len(t)]
            elif s in ("iva", "ivo", "ivas", "ivos") and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
    if w == was:
        s = _longest(w, "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras".split(), rv)
        if s:
            w = w[: -len(s)]
    if w != was:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    elif s := _longest(w, "os a i o á í ó".split(), rv):
        w = w[: -len(s)]
    s = _longest(w, ("e", "é", "ê"), rv)
    if s:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


def french(word: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    w = word.lower()
    w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])|(?<=[{v}])y|y(?=[{v}])|(?<=q)u", lambda m: m[0].upper(), w)
    if re.match(f"[{v}]{{2}}", w) or w.startswith(("par", "col", "tap")):
        rv = min(3, len(w))
    else:
        k = next((k for k in range(1, len(w)) if w[k] in v), len(w))
        rv = k + 1
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    was, more = w, False
    plain = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
    ations = "atrice ateur ation atrices ateurs ations".split()
    s = _longest(w, [*plain, *ations, "logie", "logies", "usion", "ution", "usions", "utions", "ence", "ences", "ement", "ements", "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments"])
    if s:
        stem, n = w[: -len(s)], len(w) - len(s)
        if s in plain and n >= r2:
            w = stem
        elif s in ations and n >= r2:
            w = stem
            if w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif s in ("logie", "logies") and n >= r2:
            w = stem + "log"
        elif s in ("usion", "ution", "usions", "utions") and n >= r2:
            w = stem + "u"
        elif s in ("ence", "ences") and n >= r2:
            w = stem + "ent"
        elif s in ("ement", "ements") and n >= rv:
            w = stem
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            elif w.endswith("eus"):
                w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
            elif t := _longest(w, ("abl", "iqU"), r2):
                w = w[: -len(t)]
            elif t := _longest(w, ("ièr", "Ièr"), rv):
                w = w[: -len(t)] + "i"
        elif s in ("ité", "ités") and n >= r2:
            w = stem
            if w.endswith("abil"):
                w = w[:-4] if len(w) - 4 >= r2 else w[:-4] + "abl"
            elif w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
            elif w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
        elif s in ("if", "ive", "ifs", "ives") and n >= r2:
            w = stem
            if w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif s == "eaux":
            w = stem + "eau"
        elif s == "aux" and n >= r1:
            w = stem + "al"
        elif s in ("euse", "euses"):
            w = stem if n >= r2 else stem + "eux" if n >= r1 else w
        elif s in ("issement", "issements") and n >= r1 and stem[-1:] not in v:
            w = stem
        elif s == "amment" and n >= rv:
            w, more = stem + "ant", True
        elif s == "emment" and n >= rv:
            w, more = stem + "ent", True
        elif s in ("ment", "ments") and n > rv and stem[-1:] in v:
            w, more = stem, True
    changed = w != was
    if not changed or more:
        s = _longest(w, "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split(), rv)
        if s and len(w) - len(s) > rv and w[: -len(s)][-1:] not in v:
            w, changed = w[: -len(s)], True
        else:
            ee = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
            aa = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
            s = _longest(w, [*ee, *aa, "ions"], rv)
            if s == "ions" and len(w) - 4 >= r2 or s in ee:
                w, changed = w[: -len(s)], True
            elif s in aa:
                w, changed = w[: -len(s)], True
                if w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
    if changed:
        w = re.sub("Y$", "i", re.sub("ç$", "c", w))
    else:
        if w.endswith("s") and w[-2:-1] not in "aiouès":
            w = w[:-1]
        s = _longest(w, "ion ier ière Ier Ière e ë".split(), rv)
        if s == "ion":
            if len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
                w = w[:-3]
        elif s in ("ier", "ière", "Ier", "Ière"):
            w = w[: -len(s)] + "i"
        elif s == "e":
            w = w[:-1]
        elif s == "ë" and w.endswith("guë"):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè]([^{v}]+)$", r"e\1", w)
    return w.lower()




# Finnish

# Vowels, and endings with what must stand before them.
_FI_VOWELS, _FI_CONSONANTS = "aeiouyäö", "bcdfghjklmnpqrstvwxz"
_FI_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")
_FI_PARTICLES = "kin kaan kään ko kö han hän pa pä sti".split()
_FI_POSSESSIVES = {"nsa": "", "nsä": "", "mme": "", "nne": "", "ni": "", "si": "[^k]", "an": "ta|na|ssa|sta|lla|lta", "än": "tä|nä|ssä|stä|llä|ltä", "en": "lle|ine"}
_FI_CASES = (
    {"siin": "[aeiouäö]i", "tten": "[aeiouäö]i", "seen": "|".join(_FI_LONG), "den": "[aeiouäö]i"}
    | {f"h{x}n": x for x in "aeioäö"}
    | {"tta": "e", "ttä": "e"}
    | dict.fromkeys("ssa ssä sta stä lla llä lta ltä lle ksi ine ta tä na nä n".split(), "")
    | dict.fromkeys("aä", f"[{_FI_CONSONANTS}][{_FI_VOWELS}]")
)
_FI_COMPARISON = "impi impa impä immi imma immä mpi mpa mpä mmi mma mmä eja ejä".split()


def finnish(word: str) -> str:
    """Particles, possessives, cases, comparison and plurals go inside R1 and R2; long vowels and double consonants at the end become short."""
    v, w = _FI_VOWELS, word.lower()
    r1 = _region(w, v)
    r2 = _region(w, v, r1)
    s = _longest(w, _FI_PARTICLES, r1)
    if s and (len(w) - len(s) >= r2 if s == "sti" else w[-len(s) - 1] in v + "nt"):
        w = w[: -len(s)]
    s = _longest(w, _FI_POSSESSIVES, r1)
    if s and re.search(f"(?:{_FI_POSSESSIVES[s]})$", w[: -len(s)]):
        w = w[: -len(s)]
        if s == "ni" and w.endswith("kse"):
            w = w[:-1] + "i"
    cased = False
    for s in sorted(_FI_CASES, key=len, reverse=True):
        if w.endswith(s) and len(w) - len(s) >= r1:
            if re.search(f"(?:{_FI_CASES[s]})$", w[: -len(s)]):
                w, cased = w[: -len(s)], True
                if s == "n" and w.endswith((*_FI_LONG, "ie")):
                    w = w[:-1]
            if cased or s not in ("siin", "tten", "seen", "den"):  # these give way to shorter endings
                break
    s = _longest(w, _FI_COMPARISON, r2)
    if s and not (s[0] == "m" and w[: -len(s)].endswith("po")):
        w = w[: -len(s)]
    if cased and len(w) > r1 and w[-1] in "ij":
        w = w[:-1]
    elif not cased and len(w) - 2 >= r1 and re.search(f"[{v}]t$", w):
        w = w[:-1]
        s = _longest(w, ("imma", "mma"), r2)
        if s and not (s == "mma" and w[r2:-3].endswith("po")):
            w = w[: -len(s)]
    for ending in ("|".join(_FI_LONG), f"[{_FI_CONSONANTS}][aäei]", "[ou]j", "jo"):
        if len(w) - 2 >= r1 and re.search(f"(?:{ending})$", w):
            w = w[:-1]
    return re.sub(rf"([{_FI_CONSONANTS}])\1([{v}]*)$", r"\1\2", w)


# Romanian

# Vowels, and the endings of each step with what they leave.
_RO_VOWELS = "aeiouăâî"
_RO_PLURAL = {"ul": "", "ului": "", "aua": "a", "atei": "at", "ile": "i", "aţie": "aţi", "aţia": "aţi"} | dict.fromkeys("ea ele elor".split(), "e") | dict.fromkeys("ii iua iei iile iilor ilor".split(), "i")
_RO_COMBINED = (
    {"ibilitate": "ibil"}
    | dict.fromkeys("abilitate abilitati abilităi abilităţi".split(), "abil")
    | dict.fromkeys("ivitate ivitati ivităi ivităţi".split(), "iv")
    | dict.fromkeys("icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală".split(), "ic")
    | dict.fromkeys("ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători".split(), "at")
    | dict.fromkeys("itiv itiva itive itivi itivă iţiune itoare itor itori".split(), "it")
)
_RO_STANDARD = (
    dict.fromkeys("abila abile abili abilă ibila ibile ibili ibilă atori itate itati ităţi abil ibil oasa oasă oase anta ante anti antă ator ităi ata ată ati ate uta ută uti ute ita ită iti ite ica ice ici ică osi oşi ant iva ive ivi ivă at ut it ic os iv".split(), "")
    | dict.fromkeys("iune iuni".split(), "t")
    | dict.fromkeys("ism isme ist ista iste isti istă işti".split(), "ist")
)
_RO_VERB_FREE = "seserăţi seserăm serăţi seseşi seseră serăm sesem seşi seră sese aţi eţi iţi âţi sei ăm em im âm se".split()
_RO_VERB = "aserăţi iserăţi âserăţi userăţi aserăm iserăm âserăm userăm ească arăţi urăţi irăţi ârăţi aseşi aseră iseşi iseră âseşi âseră useşi useră indu ându ează eşti eşte ăşti ăşte eaţi iaţi arăm urăm irăm ârăm asem isem âsem usem are ere ire âre ind ând eze ezi esc ăsc eam eai eau iam iai iau aşi ară uşi ură işi iră âşi âră ase ise âse use ez am ai au ea ia ui âi".split()


def romanian(word: str) -> str:
    """Plurals, combined and standard endings in R1 and R2, else verb endings in RV, then a final vowel; i and u between vowels count as consonants."""
    v = _RO_VOWELS
    w = re.sub(f"(?<=[{v}])[iu](?=[{v}])", lambda m: m[0].upper(), word.lower())
    r1 = _region(w, v)
    r2, rv = _region(w, v, r1), _rv(w, v)
    s = _longest(w, _RO_PLURAL)
    if s and len(w) - len(s) >= r1 and not (s == "ile" and w.endswith("abile")):
        w = w[: -len(s)] + _RO_PLURAL[s]
    changed = False
    while (s := _longest(w, _RO_COMBINED)) and len(w) - len(s) >= r1:
        w, changed = w[: -len(s)] + _RO_COMBINED[s], True
    s = _longest(w, _RO_STANDARD)
    if s and len(w) - len(s) >= r2:
        changed = True
        if s not in ("iune", "iuni"):
            w = w[: -len(s)] + _RO_STANDARD[s]
        elif w[-5:-4] == "ţ":
            w = w[:-5] + _RO_STANDARD[s]
    if not changed and (s := _longest(w, [*_RO_VERB_FREE, *_RO_VERB], rv)):
        at = len(w) - len(s)
        if s in _RO_VERB_FREE or at > rv and w[at - 1] not in "aeioăâî":
            w = w[:at]
    s = _longest(w, "ie a e i ă".split())
    if s and len(w) - len(s) >= rv:
        w = w[: -len(s)]
    return w.lower()# Hungarian

# Vowels, digraphs, doubled consonants, and the endings of each step in the order in which they are tried.
_HU_VOWELS, _HU_DIGRAPHS = "aeiouöüáéíóõúû", "cs dz dzs gy ly ny ty zs".split()
_HU_DOUBLES = "bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs".split()
_HU_CASES = "képpen onként enként anként képp ként ban ben nak nek val vel tól tõl ról rõl ból bõl hoz hez höz nál nél ért kor ba be ra re ig at et ot öt ul ül vá vé en on an ön n t".split()
_HU_SPECIAL = "ánként án én".split()
_HU_OTHER = "astul estül ástul éstül stul stül".split()
_HU_OWNED = "oké öké aké eké áké áéi éké ééi ké éi éé é".split()
_HU_SINGULAR = "ájuk éjük ünk unk juk jük ánk énk nk uk ük em om am od ed ad öd ja je ám ád ém éd m d a e o á é".split()
_HU_PLURAL_OWNER = "jaitok jeitek jaink jeink aitok eitek áitok éitek jaim jeim jaid jeid eink aink itek jeik jaik áink éink aim eim aid eid jai jei ink aik eik áim áid áik éim éid éik im id ai ei ik ái éi i".split()
_HU_PLURAL = "ák ék ök ok ek ak k".split()


def _shortened(endings: list[str], left_out: tuple[str, ...] = ()) -> dict[str, str]:
    """What is left of endings that begin with a long vowel: the short one."""
    return {s: {"á": "a", "é": "e"}[s[0]] for s in endings if s[0] in "áé" and s not in left_out}


#: The steps behind the cases: endings, what they leave, and whether the word decides on the ending (nothing goes if it is not in the region).
_HU_STEPS = (
    (_HU_OWNED, _shortened(_HU_OWNED, ("éi", "é")), False),
    (_HU_SINGULAR, _shortened(_HU_SINGULAR), True),
    (_HU_PLURAL_OWNER, _shortened(_HU_PLURAL_OWNER), True),
    (_HU_PLURAL, _shortened(_HU_PLURAL), True),
)


def hungarian(word: str) -> str:
    """Cases, owners and plurals go one after another, inside the region behind the first vowel (or, after a vowel, the first consonant or digraph)."""
    w = word.lower()
    r = _hungarian_region(w)
    w, r = _undoubled(w, r, 2) if r.endswith(("al", "el")) else (w, r)
    before = r
    w, r = _peeled(w, r, _HU_CASES, {}, True)
    if r != before and r[-1:] in ("á", "é"):
        short = {"á": "a", "é": "e"}[r[-1]]
        w, r = w[:-1] + short, r[:-1] + short
    for endings in (_HU_SPECIAL, _HU_OTHER):
        w, r = _peeled(w, r, endings, _shortened(endings), False)
    w, r = _undoubled(w, r, 1) if r.endswith(("á", "é")) else (w, r)
    for endings, left, whole in _HU_STEPS:
        w, r = _peeled(w, r, endings, left, whole)
    return w


def _hungarian_region(w: str) -> str:
    if not w:
        return ""
    if w[0] not in _HU_VOWELS:
        return next((w[k + 1 :] for k in range(1, len(w)) if w[k] in _HU_VOWELS), "")
    digraph = next((d for d in _HU_DIGRAPHS if d in w[1:]), None)
    if digraph:  # the first of the list, up to where its last letter stands first
        return w[w.index(digraph[-1]) + 1 :]
    return next((w[k + 1 :] for k in range(1, len(w)) if w[k] not in _HU_VOWELS), "")


def _undoubled(w: str, r: str, ending: int) -> tuple[str, str]:
    """Without an ending of so many letters and without the doubling before it, where there is one."""
    cut = lambda x: x[: -ending - 2] + x[-ending - 1]
    for double in _HU_DOUBLES:
        if w[-ending - len(double) : -ending] == double:
            return cut(w), cut(r) if r[-ending - len(double) : -ending] == double else r
    return w, r


def _peeled(w: str, r: str, endings: list[str], left: dict[str, str], whole: bool) -> tuple[str, str]:
    """Without the first ending that fits the region (``whole``: that fits the word, if it is in the region)."""
    for s in endings:
        if (w if whole else r).endswith(s):
            if r.endswith(s):
                w, r = w[: -len(s)] + left.get(s, ""), r[: -len(s)] + left.get(s, "")
            break
    return w, r


# Russian

_RU = {
    "perfective1": "в вши вшись".split(),
    "perfective2": "ив ивши ившись ыв ывши ывшись".split(),
    "adjective": "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split(),
    "participle1": "ем нн вш ющ щ".split(),
    "participle2": "ивш ывш ующ".split(),
    "reflexive": "ся сь".split(),
    "verb1": "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "verb2": "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
    "noun": "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split(),
}


def russian(word: str) -> str:
    v = "аеиоуыэюя"
    w = word.lower().replace("ё", "е")
    rv = next((k + 1 for k, c in enumerate(w) if c in v), len(w))
    r2 = _region(w, v, _region(w, v))

    def strip(w: str, one: str | None, two: str) -> str | None:
        a = [s for s in _RU.get(one or "", ()) if w.endswith(s) and len(w) - len(s) - 1 >= rv and w[: -len(s)][-1] in "ая"]
        b = [s for s in _RU[two] if w.endswith(s) and len(w) - len(s) >= rv]
        s = max(a + b, key=len, default=None)
        return None if s is None else w[: -len(s)]

    out = strip(w, "perfective1", "perfective2")
    if out is None:
        out = strip(w, None, "reflexive") or w
        adjective = strip(out, None, "adjective")
        if adjective is not None:
            out = strip(adjective, "participle1", "participle2") or adjective
        else:
            verb = strip(out, "verb1", "verb2")
            out = verb if verb is not None else strip(out, None, "noun") or out
    w = out
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    if s := _longest(w, ("ост", "ость"), r2):
        w = w[: -len(s)]
    if s := _longest(w, ("ейш", "ейше"), rv):
        w = w[: -len(s)]
    if w.endswith("нн") and len(w) - 1 >= rv:
        w = w[:-1]
    elif w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w


STEMMERS: dict[str, Callable[[str], str]] = {
    "en": porter, "porter": porter, "porter2": porter2, "da": danish, "de": german, "es": spanish, "fi": finnish, "fr": french, "hu": hungarian,
    "it": italian, "nl": dutch, "no": norwegian, "pt": portuguese, "ro": romanian, "ru": russian, "sv": swedish, "ar": isri, "isri": isri,
}


def register_stemmer(name: str):
    def add(fn: Callable[[str], str]) -> Callable[[str], str]:
        STEMMERS[name] = fn
        return fn

    return add


def stemmer_for(language: str) -> Callable[[str], str]:
    from quarry.functions.languages import two_letter_code

    for key in (language, two_letter_code(language)):
        if key in STEMMERS:
            return STEMMERS[key]
    raise ValueError(f"no stemmer for {language!r}")


def identity(word: str) -> str:
    return word


def with_overrides(stem: Callable[[str], str], words: dict[str, str]) -> Callable[[str], str]:
    """A stemmer with its own stems for some words."""
    return functools.lru_cache(maxsize=100_000)(lambda w: words.get(w) or stem(w))


def compare(a: Callable[[str], str], b: Callable[[str], str], words: Iterable[str]) -> dict[str, tuple[str, str]]:
    """Words on which two stemmers differ."""
    return {w: (a(w), b(w)) for w in words if a(w) != b(w)}


# Paice-Husk: an engine for rule tables


class PaiceHusk:
    """Applies rules of the form ending-backwards [*] count [append] (> or .), one per line.

    A rule fits if the word ends so (with *, only an unchanged word); it removes ``count`` letters, appends, and goes on (>) or
    stops (.). A result must keep a vowel and two letters, or, starting with a consonant, three letters and a vowel or y.
    """

    def __init__(self, rules: str):
        self.rules: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
        for m in re.finditer(r"^\s*([a-z]+)(\*?)(\d)([a-z]*)([>.])", rules, re.M):
            ending = m[1][::-1]
            self.rules.setdefault(ending[-1], []).append((ending, bool(m[2]), int(m[3]), m[4], m[5] == ">"))

    @staticmethod
    def _keeps(word: str) -> bool:
        if word[:1] in tuple("aeiou"):
            return len(word) >= 2
        return len(word) >= 3 and bool(re.search("[aeiouy]", word))

    def __call__(self, word: str) -> str:
        w, changed, more = word.lower(), False, True
        while more and w:
            more = False
            for ending, intact, count, append, again in self.rules.get(w[-1], ()):
                if not w.endswith(ending) or intact and changed:
                    continue
                new = (w[: len(w) - count] if count else w) + append
                if self._keeps(new):
                    more = again and (new != w or count > 0)
                    w, changed = new, True
                    break
        return w
