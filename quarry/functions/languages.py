"""Languages: codes, stop words, stemmers and detection by stop words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and three-letter codes of languages.
CODES = {
    "arabic": "ar", "danish": "da", "dutch": "nl", "english": "en", "finnish": "fi", "french": "fr", "german": "de", "hungarian": "hu", "italian": "it",
    "norwegian": "no", "portuguese": "pt", "romanian": "ro", "russian": "ru", "spanish": "es", "swedish": "sv", "turkish": "tr",
    "ara": "ar", "dan": "da", "nld": "nl", "dut": "nl", "eng": "en", "fin": "fi", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "hun": "hu", "ita": "it",
    "nor": "no", "nob": "no", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "spa": "es", "swe": "sv", "tur": "tr",
}

#: Function words. English is a whole published list; the others are the most frequent words, so pass a longer list where one is wanted.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "en": tuple("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()),
    "fr": tuple("à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ont ou où par pas pour plus qu que qui sa sans se ses son sont sur ta te tes toi ton tu un une vos votre vous y été être".split()),
    "de": tuple("aber alle als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann mein mich mir mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur".split()),
    "es": tuple("a al algo como con de del desde donde dos el ella ellos en entre era es esta este esto fue ha hasta la las le les lo los más me mi muy nada ni no nos o os para pero por que quien se sin sobre son su sus también te tiene todo tu un una uno y ya yo".split()),
    "it": tuple("a ad al alla alle anche che chi ci come con da dal dalla dei del della delle di e è gli ha hanno i il in io la le lei li lo loro lui ma mi nel nella noi non nostro o per perché più quale quella quello questa questo se si sono su sul sulla suo tra tu un una uno vi voi".split()),
    "pt": tuple("a ao aos as até com como da das de dela dele do dos e é ela ele em entre era essa esse esta este eu foi há isso já lhe mais mas me mesmo meu minha muito na não nas nem no nos nós o os ou para pela pelo por qual quando que se sem seu sua são também te tem um uma você".split()),
    "nl": tuple("aan al als bij dan dat de der deze die dit door een en er ge haar had heb hebben heeft het hier hij hoe hun ik in is ja je kan maar me meer men met mij mijn na naar niet nog nu of om onder ons ook op over te tot uit van veel voor want was wat we wel werd wie zal ze zich zij zijn zo zou".split()),
    "sv": tuple("alla att av blev bli då de dem den denna det dig din du där efter ej eller en er ett från för ha hade han hans har hon här i icke inom inte jag ju kan kunde man med men mig min mot mycket ni nu när någon och om oss på sedan sig sin skulle som så till under upp ut var vara vi vid vill är".split()),
    "da": tuple("af alle at blev bliver da de dem den denne der det dig din disse dog du efter eller en end er et for fra ham han hans har havde hende her hos hun hvad hvis hvor i ikke ind jeg jo kunne man mange med meget men mig min mod når noget og om op os over på selv sig skal som sådan til ud under var vi vil ville".split()),
    "no": tuple("alle at av bare ble bli da de deg dem den denne der deres det dette din du eller en enn er et etter for fra før ha hadde han hans har hun hva hvis hvor i ikke ja jeg kan kunne man med meg men min mot når noe og om opp oss over på så seg selv sin skal skulle som til under ut var ved vi vil ville være".split()),
    "fi": tuple("ei eivät en että he hän hänen häntä ja joka jos jotka kanssa kuin kun me mikä minä mitä mukaan mutta ne niin nyt ole oli olla on ovat se sekä sen siitä sinä tai tämä te vaan vain voi".split()),
    "hu": tuple("a abban ahogy ahol aki ami az azok azt be csak de egy egyik el ez ezek ezt és fel ha hanem hogy itt is ki kell le lehet lesz mely meg mert mi mint minden most nagyon ne nem nincs olyan ott össze s sem szerint talán vagy van volt".split()),
    "ro": tuple("a acea aceasta acest al ale am ar are au ca care ce cel cu cum da dar de din după ea el este eu fi fost în îi la le lui mai ne ni nu o pe pentru prin să se și sunt te un una".split()),
    "ru": tuple("а без более бы был была были было быть в вам вас весь во вот все всего вы где да для до его ее если есть еще же за и из или им их к как ко когда кто ли мне мы на над нас не него нет ни но о об он она они от по под при с со так там то того только ты у уже что чтобы эта это я".split()),
    "tr": tuple("acaba ama bana bazı belki ben beni bir biri biz bu çok çünkü da daha de değil diye en gibi hem hep her hiç için ile ise kez ki kim mı mi mu nasıl ne neden nerede niçin o sanki şey siz şu tüm ve veya ya yani".split()),
}


def two_letter_code(name: str) -> str | None:
    """Two-letter code of a language by name, two- or three-letter code; null if unknown."""
    name = name.strip().lower()
    return name if name in CODES.values() else CODES.get(name) or (name[:2] if len(name) > 2 and name[2] in "-_" and name[:2] in CODES.values() else None)


def stop_words(code: str) -> tuple[str, ...]:
    """Stop words of a language; empty if unknown."""
    return STOP_WORDS.get(two_letter_code(code) or "", ())


def has_stop_words(code: str) -> bool:
    return bool(stop_words(code))


def has_stemmer(code: str) -> bool:
    from quarry.functions.stemming import STEMMERS

    return (two_letter_code(code) or "") in STEMMERS


def _member(listed: list[str]):
    return lambda w: w.isin(listed)


def detect(text: Column, languages: Sequence[str] = ("fr", "en", "de", "es", "it"), lists: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The language with the most stop words among the white-space separated, lower-cased words; ties: the first listed; empty text: ''."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    best, most = F.lit(""), F.lit(0)
    for code in languages:
        listed = list((lists or STOP_WORDS)[code])
        hits = F.size(F.filter(words, _member(listed)))
        best, most = F.when(hits > most, F.lit(code)).otherwise(best), F.greatest(hits, most)
    return best


#: Detectors by name: a Column of texts to a Column of two-letter codes.
DETECTORS: dict = {"stopwords": detect}


def register_detector(name: str, fn) -> None:
    DETECTORS[name] = fn


def langdetect(text: Column) -> Column:
    """Codes by the library of this name, where it is installed; null where it finds none."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        from langdetect import DetectorFactory, LangDetectException, detect as find

        DetectorFactory.seed = 0

        def one(t):
            try:
                return find(t) if t else None
            except LangDetectException:
                return None

        return texts.map(one)

    return run(text)


DETECTORS["langdetect"] = langdetect


def detect_with(name: str, text: Column) -> Column:
    if name not in DETECTORS:
        raise KeyError(f"{name!r} is not one of {sorted(DETECTORS)}")
    return DETECTORS[name](text)
