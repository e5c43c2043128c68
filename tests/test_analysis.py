import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis as A
from quarry.functions import distance, languages, morphology, phonetics, stemming

TEXTS = ["The quick.brown Fox_1 jumps over the lazy dog", "été à Noël c'est l'hiver", "", None, "a b c", "Wi-Fi PowerShot500 ABCdef 3.14", "one", "/usr/local/bin", "x*y * tags, more , tags"]

CHAINS = {
    "standard": A.standard(),
    "simple": A.simple(),
    "keyword": A.keyword(True),
    "commas": A.keyword(commas=True),
    "fancy": A.fancy(),
    "ngram": A.ngram(2, 3),
    "words": A.ngram_words(2, 3),
    "start": A.autocomplete(2, 4),
    "end": A.ngram_words(2, 3, "end"),
    "shingle": A.space_tokenizer() | A.shingle(3),
    "biword": A.standard() | A.biword(),
    "reverse": A.simple() | A.reverse(),
    "path": A.Analyzer([A.path_tokenizer()]),
    "gaps": A.Analyzer([A.regex_tokenizer(r"[\s,]+", gaps=True)]),
    "subst": A.simple() | A.substitution("(o)(.)", r"\2\1"),
    "charset": A.simple() | A.charset({"é": "e", "ß": "ss"}),
    "delimited": A.space_tokenizer() | A.delimited_attribute(),
    "tee": A.simple() | A.tee([A.reverse()], [A.passthrough()]),
    "stem": A.stemming(),
    "compound": A.simple() | A.compound_words(["power", "shot", "jump", "s"]),
    "metaphone": A.simple() | A.phonetic(),
    "multi": A.multi_language(["en", "fr"]),
    "split": A.space_tokenizer() | A.intraword(merge_words=True),
}


@pytest.mark.parametrize("name", CHAINS)
def test_columns_and_python_agree(spark, name):
    chain = CHAINS[name]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["terms"] for r in df.select("i", chain.terms(F.col("t")).alias("terms")).collect()}
    assert got == {i: chain.analyze(t) for i, t in enumerate(TEXTS)}


def test_positions_have_no_holes_and_start_at_the_first_kept_raw_index(spark):
    df = spark.createDataFrame([("the quick and the dead",)], "t string")
    got = df.select(A.standard().tokens(F.col("t")).alias("x")).first()["x"]
    assert [(x["term"], x["pos"]) for x in got] == [("quick", 1), ("dead", 2)]


def test_an_analyzer_is_one_tokenizer_and_filters():
    with pytest.raises(ValueError):
        A.Analyzer([A.lowercase()])
    with pytest.raises(ValueError):
        A.space_tokenizer() | A.space_tokenizer()


def test_published_stems():
    assert [stemming.porter(w) for w in "caresses ponies relational hopping happy adjustable".split()] == "caress poni relat hop happi adjust".split()
    assert [stemming.porter2(w) for w in "consistency knightly generously dying".split()] == "consist knight generous die".split()
    assert [stemming.german(w) for w in "kategorischen häuser".split()] == "kategor haus".split()
    assert [stemming.spanish(w) for w in "torneado cheques".split()] == "torn chequ".split()
    assert [stemming.french(w) for w in "continuellement majestueusement".split()] == "continuel majestu".split()
    assert stemming.swedish("jaktkarlarne") == "jaktkarl" and stemming.danish("undersøgelse") == "undersøg" and stemming.norwegian("havnedistriktene") == "havnedistrikt"
    assert stemming.russian("важнейшими") == "важн" and stemming.portuguese("quilométricas") == "quilométr" and stemming.dutch("lichamelijkheden") == "licham"


@pytest.mark.parametrize("code", sorted(stemming.STEMMERS))
def test_stemmers_take_any_word(code):
    for w in ["", "a", "ss", "y", "été", "ниимии", "123", "eeeeee", "ingly", "sesses", "ablement", "agglutination" * 3]:
        assert isinstance(stemming.STEMMERS[code](w), str)


def test_phonetics():
    assert phonetics.soundex_en("Robert") == "r163" and phonetics.soundex_en("") == ""
    assert phonetics.double_metaphone("Smith") == ("SM0", "XMT")
    assert phonetics.double_metaphone("Thompson")[0] == "TMPSN"
    assert phonetics.double_metaphone("") == ("", "")
    for w in ["Knight", "Xavier", "Czech", "bough", "Hugh", "jose", "Arnoff", "Schmidt", "pizza", "Wright"]:
        assert phonetics.double_metaphone(w)[0]


def test_distances(spark):
    assert distance.osa("abcd", "acbd") == 1 and distance.osa("", "abc") == 3 and distance.osa("kitten", "sitting") == 3 and distance.osa("abcdef", "x", 2) == 3
    words = [("acbd",), ("abcd",), ("abce",), ("xbcd",), ("abdc",), ("zzzz",), (None,)]
    df = spark.createDataFrame(words, "w string")
    for k in (0, 1, 2):
        got = {r["w"] for r in df.where(distance.osa_within(F.col("w"), "abcd", k)).collect()}
        assert got == {w for (w,) in words if w is not None and distance.osa(w, "abcd") <= k}
    row = spark.createDataFrame([("abcd", "abc"), ("", "")], "a string, b string").select(distance.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in row] == [0.5625, 1.0]
    order = spark.createDataFrame([("a10",), ("a9",), ("a1b",)], "s string").orderBy(distance.natural_sort(F.col("s"))).collect()
    assert [r["s"] for r in order] == ["a1b", "a9", "a10"]


def test_languages(spark):
    df = spark.createDataFrame([("the cat is on the mat",), ("der Hund ist in dem Haus",), ("",), (None,), ("zzz qqq",)], "t string")
    assert [r["l"] for r in df.select(languages.detect(F.col("t")).alias("l")).collect()] == ["en", "de", "", "", ""]
    assert languages.two_letter_code("German") == "de" and languages.two_letter_code("deu") == "de" and languages.two_letter_code("en-US") == "en" and languages.two_letter_code("klingon") is None
    assert languages.has_stemmer("fr") and not languages.has_stemmer("tr") and languages.has_stop_words("tr")


def test_variations():
    assert {"render", "renders", "rendered", "rendering"} <= morphology.variations("render")
    assert {"stopped", "stopping"} <= morphology.variations("stop") and "children" in morphology.variations("child")


def test_paice_husk():
    stem = stemming.PaiceHusk("gni3>\nde2>\nsei3y>\ns*1>\nylb1>\n e1>\nnoi3j>\n")
    assert stem("maximising") == "maximis" and stem("parties") == "party" and stem("cats") == "cat" and stem("ring") == "ring"


def test_arabic_roots(spark):
    """Roots worked out by hand, one for each step and many of the templates."""
    from quarry.functions.arabic import isri
    from quarry.functions.stemming import stemmer_for

    roots = {
        "المدرسة": "درس", "والكتاب": "كتب", "يكتبون": "كتب", "كاتب": "كتب", "مكتوب": "كتب", "كَتَبَ": "كتب", "استعمل": "عمل", "انكسر": "كسر", "مدارس": "درس", "تفاعيل": "فعل", "افتتاح": "فتح",
        "اعشوشب": "عشب", "ترجمة": "رجم", "فاكهة": "فكه", "أكل": "اكل", "التي": "التي", "شمس": "شمس", "قناديل": "قناديل", "hello": "hello", "": "",
    }
    assert {w: isri(w) for w in roots} == roots
    assert stemmer_for("arabic") is isri and stemmer_for("ar") is isri
    chain = A.simple() | A.stem("ar")
    got = spark.createDataFrame([("والكتاب مكتوب hello",)], "t string").select(chain.terms(F.col("t"))).first()[0]
    assert got == ["كتب", "كتب", "hello"] == chain.analyze("والكتاب مكتوب hello")


def test_hungarian_stems():
    """Stems worked out by hand, one or more for each step."""
    stems = {
        "babák": "baba", "házban": "ház", "almával": "alm", "kettel": "ket", "asztalokkal": "asztal", "embereknek": "ember", "könyveiben": "könyv", "gyerekekkel": "gyerek", "városánként": "város",
        "kutyáink": "kutya", "képünk": "kép", "ék": "ék", "a": "a", "": "", "xyz": "xyz",
    }
    assert {w: stemming.stemmer_for("hungarian")(w) for w in stems} == stems


def test_finnish_and_romanian_stems():
    """Stems worked out by hand, one or more for each step."""
    finnish = {
        "edeltäjien": "edeltäj", "edeltäjän": "edeltäj", "edeltäjä": "edeltäj", "edeltävällä": "edeltäv", "edeltäneet": "edeltän", "edelsi": "edel", "edemmäs": "edemmäs", "edemmäksi": "edem", "eduskunnassa": "eduskun",
        "taloissa": "talo", "taloonko": "talo", "kirjakseni": "kirj", "eläkkeen": "eläk", "": "", "xyz": "xyz",
    }
    romanian = {
        "abruptă": "abrupt", "absentă": "absent", "absolvirea": "absolv", "abundente": "abundent", "academicienilor": "academicien", "activitatea": "activ", "adorabilă": "ador", "casele": "cas",
        "elevului": "elev", "prietenii": "prieten", "vorbeşte": "vorb", "lucrând": "lucr", "": "", "a": "a",
    }
    for code, stems in (("fi", finnish), ("romanian", romanian)):
        assert {w: stemming.stemmer_for(code)(w) for w in stems} == stems
