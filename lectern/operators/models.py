"""Stems, word vectors, projections: what needs a model or a rule engine."""

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

# The suffix rules of Porter's published algorithm, steps 2 to 4.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """Porter's stem of a lower-case ASCII word; other words are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    kinds = lambda w: "".join("v" if c in "aeiou" or c == "y" and k and w[k - 1] not in "aeiou" else "c" for k, c in enumerate(w))
    measure = lambda w: len(re.findall("v+c+", kinds(w)))
    vowel = lambda w: "v" in kinds(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and kinds(w)[-1] == "c"
    cvc = lambda w: len(w) > 2 and kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"

    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and cvc(word):
                    word += "e"
                break
    if word.endswith("y") and vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        if end := max((e for e in rules if word.endswith(e)), key=len, default=None):
            stem = word[: -len(end)]
            word = stem + rules[end] if measure(stem) > 0 else word
    if end := max((e for e in STEP_4 if word.endswith(e)), key=len, default=None):
        stem = word[: -len(end)]
        if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if measure(stem) > 1 or measure(stem) == 1 and not cvc(stem):
            word = stem
    return word[:-1] if measure(word) > 1 and double(word) and word.endswith("l") else word


# The word lists and suffix rules of the published English Snowball algorithm.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AS_THEY_ARE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_STARTS = ("gener", "commun", "arsen")
SNOWBALL_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
SNOWBALL_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
SNOWBALL_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_SHORT = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _end(word: str, ends: Iterable[str]) -> str:
    """The longest of the ends that the word has, or none."""
    return max((e for e in ends if word.endswith(e)), key=len, default="")


def snowball(word: str) -> str:
    """The English Snowball stem (Porter's second algorithm) of a lower-case word. Words of other letters, or of two letters or fewer, are their own."""
    word = word.replace("\u2019", "'")
    if not re.fullmatch("[a-z']{3,}", word):
        return word
    word = word.removeprefix("'")
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)

    def after(begin: int) -> int:
        """Where the region begins that follows the first non-vowel after a vowel."""
        m = re.compile("[aeiouy][^aeiouy]").search(word, begin)
        return m.end() if m else len(word)

    start = next((len(p) for p in LONG_STARTS if word.startswith(p)), None)
    r1 = after(0) if start is None else start
    r2 = after(r1)
    holds = lambda end, region: len(word) - len(end) >= region

    word = word.removesuffix(_end(word, ("'", "'s", "'s'")))
    match _end(word, ("sses", "ied", "ies", "us", "ss", "s")):
        case "sses":
            word = word[:-2]
        case "ied" | "ies":
            word = word[:-2] if len(word) > 4 else word[:-1]
        case "s" if re.search("[aeiouy].", word[:-1]):
            word = word[:-1]
    if word in AS_THEY_ARE:
        return word
    end = _end(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        if holds(end, r1):
            word = word.removesuffix(end) + "ee"
    elif end and re.search("[aeiouy]", word.removesuffix(end)):
        word = word.removesuffix(end)
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT.match(word):
            word += "e"
    if re.search(".[^aeiouy][yY]$", word):
        word = word[:-1] + "i"
    end = _end(word, SNOWBALL_2)
    if end and holds(end, r1) and (end != "ogi" or word.endswith("logi")) and (end != "li" or word[-3] in "cdeghkmnrt"):
        word = word.removesuffix(end) + SNOWBALL_2[end]
    end = _end(word, SNOWBALL_3)
    if end and holds(end, r2 if end == "ative" else r1):
        word = word.removesuffix(end) + SNOWBALL_3[end]
    end = _end(word, SNOWBALL_4)
    if end and holds(end, r2) and (end != "ion" or word.endswith(("sion", "tion"))):
        word = word.removesuffix(end)
    if word.endswith("e") and (holds("e", r2) or holds("e", r1) and not _SHORT.match(word[:-1])) or word.endswith("ll") and holds("l", r2):
        word = word[:-1]
    return word.replace("Y", "y")


STEMMERS = {"porter": porter, "snowball": snowball}


def stemmed(terms: DataFrame, col: str, algorithm: str = "porter") -> DataFrame:
    """With stem, by an Arrow-batched function over the (distinct) terms."""
    of = STEMMERS[algorithm]

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(of, na_action="ignore")

    return terms.withColumn("stem", stem(col))


def word_vectors(docs: DataFrame, text_col: str, size: int = 100, window: int = 5, passes: int = 20, least: int = 2, seed: int = 42) -> Word2VecModel:
    """Skip-gram vectors trained by Spark's own Word2Vec."""
    t = docs.select(T.terms(F.col(text_col)).alias("terms"))
    return Word2Vec(vectorSize=size, windowSize=window, maxIter=passes, minCount=least, seed=seed, inputCol="terms", outputCol="vector", numPartitions=8).fit(t)


def embed(model: Word2VecModel, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(vec_id, embedding): the mean vector of a text's known terms."""
    t = docs.select(F.col(id_col).alias("vec_id"), T.terms(F.col(text_col)).alias("terms"))
    return model.transform(t).select("vec_id", vector_to_array("vector").alias("embedding"))


def project(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int = 2, most_clusters: int = 8, seed: int = 42) -> DataFrame:
    """(id, x, cluster): PCA coordinates and KMeans clusters, min(8, sqrt(n)) of them."""
    v = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col), array_to_vector(F.col(vector_col)).alias("features"))
    n = v.count()
    if not n:
        return v.select(id_col, F.array().cast("array<double>").alias("x"), F.lit(None).cast("int").alias("cluster"))
    flat = PCA(k=dimensions, inputCol="features", outputCol="flat").fit(v).transform(v)
    clusters = KMeans(k=max(1, min(most_clusters, int(n**0.5))), seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(flat)
    return clusters.select(id_col, vector_to_array("flat").alias("x"), "cluster")
