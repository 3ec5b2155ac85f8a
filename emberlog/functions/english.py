"""English words: stop words and stems, as plain projections.

A stem is computed on rows of distinct words, one projection for each step, so
nothing is interpreted and no expression is evaluated twice. All patterns are
anchored sets of endings or single classes of letters: linear in a word's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual English stop words.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
""".split()

# Fixed values of the published English stemmer: words with a stem of their own, words that end after step 1a, endings.
OWN_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
FINAL_WORDS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

_SHORT_END = r"(?:^[aeiouy]|[^aeiouy][aeiouy])[^aeiouywxY]$|^[aeiouy][^aeiouy]$"


def words(text: Column) -> Column:
    """All words in lower case, in order: runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _ending(endings) -> Column:
    """The longest of the endings that the word has: of matches that reach the end, the leftmost is found."""
    return F.regexp_extract("_w", f"(?:{'|'.join(endings)})$", 0)


def _replaced(endings: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for ending, new in endings.items():
        out = out.when(F.col("_end") == ending, F.lit(new))
    return out


def _before(n: Column | None = None) -> Column:
    return F.substring(F.col("_w"), F.lit(1), F.length("_w") - (F.length("_end") if n is None else n))


def _from(region: str) -> Column:
    """Whether the ending lies in a region of the word."""
    return F.length("_w") - F.length("_end") >= F.col(region)


def _step(df: DataFrame, endings, *cases: tuple[Column, Column]) -> DataFrame:
    """Looks for an ending, then takes the first case that holds; a word whose work is done, or without ending, stays."""
    new = F.when(F.col("_done") | (F.col("_end") == ""), F.col("_w"))
    for condition, value in cases:
        new = new.when(condition, value)
    return df.withColumn("_end", _ending(endings)).withColumn("_w", new.otherwise(F.col("_w")))


def with_stem(df: DataFrame, word: str, stem: str = "stem") -> DataFrame:
    """df with the English stem of a column of words in lower case, by the published English (Porter 2) rules.

    Words of two letters or fewer are their own stems, letters beyond a-z
    count as consonants, null stays null. Apply it to distinct words.
    """
    w = F.col("_w")
    own = F.when(F.lit(False), F.lit(""))
    for special, value in OWN_STEMS.items():
        own = own.when(F.col(word) == special, F.lit(value))
    marked = F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), "([aeiouy])y", "$1Y")
    region = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
    df = df.withColumn("_own", F.when(F.length(word) <= 2, F.col(word)).otherwise(own)).withColumn("_w", marked).withColumn("_done", F.col("_own").isNotNull() | F.col(word).isNull())
    first = F.length(F.regexp_extract("_w", "^(?:gener|commun|arsen)", 0))
    df = df.withColumn("_head", F.when(first > 0, first).otherwise(F.length(F.regexp_extract("_w", region, 0))))
    df = df.withColumn("_r1", F.when(F.col("_head") > 0, F.col("_head")).otherwise(F.length("_w")))
    df = df.withColumn("_head", F.length(F.regexp_extract(F.substring(w, F.col("_r1") + 1, F.length("_w")), region, 0)))
    df = df.withColumn("_r2", F.when(F.col("_head") > 0, F.col("_r1") + F.col("_head")).otherwise(F.length("_w")))

    end, rest = F.col("_end"), _before()
    df = _step(
        df, ["sses", "ied", "ies", "us", "ss", "s"],
        (end == "sses", _before(F.lit(2))),
        (end.isin("ied", "ies"), F.concat(rest, F.when(F.length("_w") > 4, "i").otherwise("ie"))),
        ((end == "s") & w.rlike("[aeiouy].+s$"), rest),
    )
    df = df.withColumn("_own", F.when(w.isin(FINAL_WORDS), w).otherwise(F.col("_own"))).withColumn("_done", F.col("_done") | F.col("_own").isNotNull())

    df = df.withColumn("_old", F.length("_w"))
    df = _step(
        df, ["eedly", "ingly", "edly", "eed", "ing", "ed"],
        (end.isin("eed", "eedly"), F.when(_from("_r1"), F.concat(rest, F.lit("ee"))).otherwise(w)),
        (rest.rlike("[aeiouy]"), rest),
    )
    cut = (F.length("_w") < F.col("_old")) & ~end.isin("eed", "eedly")
    short = w.rlike(_SHORT_END) & (F.col("_r1") >= F.length("_w"))
    df = df.withColumn(
        "_w", F.when(~cut, w).when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _before(F.lit(1)))
        .when(short, F.concat(w, F.lit("e"))).otherwise(w)
    )
    df = df.withColumn("_w", F.when(~F.col("_done") & w.rlike(".[^aeiouy][yY]$"), F.concat(_before(F.lit(1)), F.lit("i"))).otherwise(w))

    df = _step(
        df, STEP_2,
        (~_from("_r1") | ((end == "ogi") & ~w.rlike("logi$")) | ((end == "li") & ~w.rlike("[cdeghkmnrt]li$")), w),
        (F.lit(True), F.concat(rest, _replaced(STEP_2))),
    )
    df = _step(df, STEP_3, (_from("_r1") & ((end != "ative") | _from("_r2")), F.concat(rest, _replaced(STEP_3))))
    df = _step(df, STEP_4, (_from("_r2") & ((end != "ion") | w.rlike("[st]ion$")), rest))
    df = _step(
        df, ["e", "l"],
        ((end == "e") & (_from("_r2") | (_from("_r1") & ~rest.rlike(_SHORT_END))), rest),
        ((end == "l") & _from("_r2") & w.rlike("ll$"), rest),
    )
    return df.withColumn(stem, F.coalesce("_own", F.translate(w, "Y", "y"))).drop("_own", "_w", "_done", "_head", "_r1", "_r2", "_end", "_old")
