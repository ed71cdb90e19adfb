"""Secret scan: candidates by shape and by name, false positives removed by a random forest; DataFrame functions and spark.ml alone.

A candidate is each run of 16 or more key characters in a blank-separated word of which a run has a digit or a well-known
key prefix, and each value of 8 or more characters, of any kind, that a name such as password is given by = or :. The
forest sees its length, character transitions (how likely its pairs of letters are in the words of the documents),
dictionary coverage (its parts that are words of the documents, or of names and paths), path marks, the neighbouring words
and what stands beside it in its own word. Words and pairs are counted over all documents.
It is trained on labelled findings - by default the built-in ones, which are made from hashes and templates here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

#: Labelled findings that the forest is trained on, at most.
FIT_FINDINGS = 8_000
TREES, DEPTH = 32, 9
#: A word counts as one of the dictionary from so many occurrences on; parts of a value from so many letters on.
LEAST_USES, LEAST_LETTERS = 3, 4
#: Words of the dictionary that the built-in findings draw their names from, at most.
NAMES = 512

_RUN = r"[A-Za-z0-9_+/\-]{16,}"
# Words that names and paths are made of, words beside secrets, and words beside other long values.
_WORDS = "user|name|test|file|path|data|index|config|value|list|item|page|view|node|type|class|model|service|client|server|request|response|manager|handler|factory|builder|default|version|release|update|create|delete|table|column|query|image|style|script|content|message|error|event|state|action|source|target|build|main|home|local|share|usr|src|lib|bin|var|etc|tmp|com|org|net|www|http|html|json|the|and|ing|tion|ment|heit|keit|schaft|ung|que|ado"
_BESIDE = "pass|pwd|secret|token|apikey|api_key|access|auth|bearer|credential|private|signature"
_OTHER = "commit|sha|md5|hash|checksum|digest|uuid|guid|revision|rev|example|sample|dummy|placeholder|etag|trace|build|file|path|url|see|version"
_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|xox[abp]-|AIza|eyJ|glpat-|npm_)"
_NAMED = r"pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|private_?key|auth(?!or)|credential"
# A prefix where a run begins.
_BEGINS = rf"(?<![A-Za-z0-9_+/\-]){_PREFIX[1:]}"
# What ends a field of a word that holds several.
_FIELD = r"[,;&|?{}]"
# A value, and a name that is given one in the same word, or by the words before.
_VALUE = r"[^\s\"'`,;&|<>(){}\[\]=:][^\s\"'`,;&|<>(){}\[\]]{7,}"
_GIVEN = rf"(?i)(?:{_NAMED})\w{{0,12}}[\"'`\])]{{0,2}}(?:=|:|=>|:=)[\"'`]?({_VALUE})"
_GIVES = rf"(?i)(?:{_NAMED})\w{{0,12}}[\"'`\])]{{0,2}}\s?(?:=|:|=>|:=|==)$"

_LETTERS = "abcdefghijklmnopqrstuvwxyz0-"
FEATURES = ["size", "run", "digits", "upper", "lower", "symbols", "others", "hexes", "turns", "pairs", "variety", "words", "known", "slashes", "dots", "at_sign", "dashes", "prefix", "assigned", "named", "quoted", "beside", "other", "sentence"]


@dataclass
class Lexicon:
    """words: a table (word) of the documents' dictionary. pairs: log probability of each pair of _LETTERS, the first by the second."""

    words: DataFrame
    pairs: list[float]


def _plain(v: Column) -> Column:
    """In lower case, digits as 0, and anything but letters and digits as -."""
    return F.regexp_replace(F.regexp_replace(F.lower(v), "[0-9]", "0"), "[^a-z0]", "-")


def lexicon(documents: DataFrame) -> Lexicon:
    """From all words of three to twenty letters in documents (text). No documents: no words, and all pairs alike.

    Words are counted in one aggregation; the driver gets one row for each pair of letters.
    """
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")
    counted = documents.select(words).where(F.length("word").between(3, 20)).groupBy("word").agg(F.count("*").alias("uses")).where(F.col("uses") >= LEAST_USES)
    counted = stored(counted, f"{scratch(documents.sparkSession, 'lexicon')}/words")
    spread = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("pair")
    found = dict(counted.select(spread, "uses").groupBy("pair").agg(F.sum("uses")).collect())
    size = len(_LETTERS)
    # every pair is seen as often as one in a hundred thousand, so digits and marks are rare beside letters
    least = sum(found.values()) / 1e5 + 1
    table = [[found.get(a + b, 0) + least for b in _LETTERS] for a in _LETTERS]
    return Lexicon(counted.select("word"), [math.log(table[i][j] / sum(table[i])) for i in range(size) for j in range(size)])


def _share(text: Column, pattern: str, size: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double") / size


def _coverage(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds known: the part of each value that words of the dictionary make up. Joined by value and word, both aggregated before."""
    parts = F.split(F.lower(F.regexp_replace("value", "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
    pieces = rows.select("value").distinct().select("value", F.explode(parts).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    held = pieces.join(lexicon.words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("letters"))
    return rows.join(held, "value", "left").withColumn("known", F.coalesce(F.col("letters") / F.length("value"), F.lit(0.0))).drop("letters")


def features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds FEATURES to rows with value, head (what stands before it in its word), word, before2, before1, after1 (strings; null: none)."""
    size, v, w, head = F.length("value").cast("double"), F.col("value"), F.col("word"), F.col("head")
    near = F.lower(F.concat_ws(" ", "before2", "before1", head))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    pairs, count = F.array(*map(F.lit, lexicon.pairs)), len(_LETTERS)
    at = lambda i: F.call_function("instr", F.lit(_LETTERS), F.col("plain").substr(i, F.lit(1))) - 1
    likely = F.aggregate(F.sequence(F.lit(1), F.length("plain") - 1), F.lit(0.0), lambda s, i: s + F.get(F.col("table"), at(i) * count + at(i + 1))) / F.greatest(F.length("plain") - 1, F.lit(1))
    rows = _coverage(rows, lexicon).withColumn("plain", _plain(v)).withColumn("table", pairs)
    rows = rows.withColumn("pairs", F.when(F.length("plain") > 1, likely).otherwise(0.0)).drop("table", "plain")
    return rows.withColumns(
        {
            "size": size, "run": F.length(w).cast("double"), "digits": _share(v, "[0-9]", size), "upper": _share(v, "[A-Z]", size), "lower": _share(v, "[a-z]", size), "symbols": _share(v, r"[_+/\-]", size), "others": _share(v, r"[^A-Za-z0-9_+/\-]", size),
            "hexes": flag(v.rlike("^[0-9a-f]+$")), "turns": _share(v, "[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])", size), "variety": F.size(F.array_distinct(F.split(v, ""))).cast("double") / size,
            "words": (size - F.length(F.regexp_replace(F.lower(v), _WORDS, ""))) / size, "slashes": F.regexp_count(w, F.lit("/")).cast("double"), "dots": F.regexp_count(w, F.lit(r"\.")).cast("double"), "at_sign": flag(w.contains("@")),
            "dashes": F.regexp_count(v, F.lit("-")).cast("double"), "prefix": flag(v.rlike(_PREFIX)), "assigned": flag(head.rlike("[=:]") | F.col("before1").rlike("^[=:]+$|[=:]$")), "quoted": flag(head.rlike("[\"'`]")),
            "named": flag(head.rlike(_GIVES.replace("$", "[\"'`]?$")) | F.concat_ws("", "before2", "before1").rlike(_GIVES)),
            "beside": flag(near.rlike(_BESIDE)), "other": flag(near.rlike(rf"\b({_OTHER})")), "sentence": flag(F.col("before1").rlike("^[a-z]+,?$") & F.col("after1").rlike("^[a-z]+[.,]?$")),
        }
    )


def first_values(rows: DataFrame) -> DataFrame:
    """Adds value and head to rows with word, before2 and before1: the value that a name is given, else the first run, else the whole word."""
    given = F.regexp_extract("word", _GIVEN, 1)
    bare = F.when(F.concat_ws("", "before2", "before1").rlike(_GIVES), F.regexp_extract("word", _VALUE, 0)).otherwise("")
    value = F.regexp_extract("word", f"({_RUN})", 1)
    rows = rows.withColumn("value", F.when(given != "", given).when(value != "", value).when(bare != "", bare).otherwise(F.col("word")))
    return rows.withColumn("head", F.col("word").substr(F.lit(1), F.position(F.col("value"), F.col("word")) - 1))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, place (of the word in the text), before2, before1, after1, value, head, word; a row for each run and each value that a name is given.

    Null and empty texts have none; texts are read whole, however long. The word of a run that is alone is whole. Otherwise it is the run's own field: what stands between the
    runs on both sides, and the one before (the name of a value, perhaps), none of it beyond a mark that ends a field. So the
    words of all runs together take no more than three times their text.
    """
    likely = F.col("text").rlike(_RUN) | F.col("text").rlike(f"(?i)(?:{_NAMED})[^\n]{{0,16}}[=:]")
    words = documents.where(likely).select(F.col("doc_id").cast("long").alias("doc_id"), F.split("text", r"\s+").alias("w"))
    near = lambda i, d: F.get("w", i + d)
    long = lambda x: (F.length(x) >= 16) & x.rlike(_RUN) & (x.rlike(rf"(?=\S*[0-9]){_RUN}") | x.rlike(_BEGINS))
    marked = lambda x: F.coalesce(x.contains("=") | x.contains(":"), F.lit(False))
    in_word = lambda x: marked(x) & x.rlike(_GIVEN)
    by_words = lambda i: marked(near(i, -1)) & F.concat(F.coalesce(near(i, -2), F.lit("")), near(i, -1)).rlike(_GIVES)
    given = lambda x, i: F.when(in_word(x), F.regexp_extract(x, _GIVEN, 1)).when(by_words(i), F.regexp_extract(x, _VALUE, 0)).otherwise("")
    found = F.filter(
        F.transform("w", lambda x, i: F.when(F.length(x) >= 8, F.struct(i.alias("place"), x.alias("word"), near(i, -2).alias("before2"), near(i, -1).alias("before1"), near(i, 1).alias("after1"), long(x).alias("long"), given(x, i).alias("given")))),
        lambda c: c.isNotNull() & (c["long"] | (c["given"] != "")),
    )
    every = words.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")
    # one row a word, so that the text is read once
    runs = F.when(F.col("long"), F.regexp_extract_all("word", F.lit(f"({_RUN})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    whole = every.select("*", runs.alias("runs"), F.split("word", _RUN).alias("gaps"))
    # word = gaps[0] runs[0] gaps[1] runs[1] ... gaps[n]
    around = lambda v, i: F.struct(v.alias("value"), F.get("runs", i - 1).alias("last"), F.get("gaps", i).alias("gap"), F.get("gaps", i + 1).alias("tail"), (F.size("runs") > 1).alias("several"))
    # a value that is no run of its own, as it stands in the word
    before = F.col("word").substr(F.lit(1), F.position(F.col("given"), F.col("word")) - 1)
    after = F.col("word").substr(F.position(F.col("given"), F.col("word")) + F.length("given"), F.length("word"))
    short = F.struct(F.col("given").alias("value"), F.lit(None).cast("string").alias("last"), before.alias("gap"), after.alias("tail"), F.lit(False).alias("several"))
    values = F.concat(F.transform("runs", around), F.when((F.col("given") != "") & ~F.array_contains("runs", F.col("given")), F.array(short)).otherwise(F.array()))
    each = whole.select("doc_id", "place", "before2", "before1", "after1", F.explode(values).alias("r")).select("doc_id", "place", "before2", "before1", "after1", "r.*")
    head = F.when(F.col("last").isNull(), F.col("gap")).when(F.col("gap").rlike(_FIELD), F.regexp_replace("gap", rf"^.*{_FIELD}", "")).otherwise(F.concat("last", "gap"))
    tail = F.when(F.col("several"), F.regexp_replace("tail", rf"{_FIELD}.*$", "")).otherwise(F.col("tail"))
    each = each.select("doc_id", "place", "before2", "before1", "after1", "value", head.alias("head"), tail.alias("tail"))
    return each.select("doc_id", "place", "before2", "before1", "after1", "value", "head", F.concat("head", "value", "tail").alias("word"))


def labelled_findings(spark: SparkSession, lexicon: Lexicon | None = None, count: int = 7_200) -> DataFrame:
    """word, before2, before1, after1, label (1: a secret): made from hashes of a row number and templates, always alike.

    With a lexicon also names that are made of its words, of NAMES of them at most.
    """
    h = "sha2(concat('finding', id), 256)"
    up, mix = f"upper(translate({h}, '0189', 'GKQZ'))", f"translate(base64(unhex({h})), '=+/', 'x7Q')"
    name = "concat_ws('{}', element_at(array('user','order','page','cache','index'), cast(id % 5 + 1 as int)), element_at(array('service','manager','handler','config','value'), cast(id div 5 % 5 + 1 as int)), element_at(array('factory','response','version','release','table2'), cast(id div 25 % 5 + 1 as int)), cast(id % 97 as string))"
    key = "element_at(array('password','secret','token','api_key','auth_token','passwd','private_key','access_token'), cast(id % 8 + 1 as int))"
    said = "element_at(array('the','of','and','with','was','key:','for','is'), cast(id div 7 % 8 + 1 as int))"
    made = [
        (1, f"concat('AKIA', substr({up}, 1, 16))", said, "'in'"), (1, f"concat('\"', substr({h}, 1, 40), '\"')", f"concat({key}, ' =')", "'the'"), (1, f"concat({key}, '=', substr({h}, 1, 16 + cast(id % 17 as int)))", said, "'on'"),
        (1, f"concat({key}, '=', substr({mix}, 1, 20 + cast(id % 20 as int)))", said, "'is'"), (1, f"concat({key}, ':', substr({mix}, 1, 32))", said, "'of'"), (1, f"concat('ghp_', substr({mix}, 1, 36))", said, "'and'"),
        (1, f"concat('sk-', substr({mix}, 1, 40))", "'Bearer'", "'to'"), (1, f"substr({mix}, 1, 40)", f"concat({key}, ':')", "'that'"),
        (0, f"substr({h}, 1, 40)", "element_at(array('commit','sha1','rev','revision','see'), cast(id % 5 + 1 as int))", "'in'"), (0, f"substr({h}, 1, 32)", "element_at(array('md5','checksum','hash','etag:','digest'), cast(id % 5 + 1 as int))", "'of'"),
        (0, f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-4', substr({h}, 13, 3), '-a', substr({h}, 17, 3), '-', substr({h}, 21, 12))", "element_at(array('uuid','id','guid','the','trace'), cast(id % 5 + 1 as int))", "'was'"),
        (0, f"concat('/usr/share/', {name.format('/')}, '.html')", said, "'and'"), (0, f"concat('https://www.example.com/', {name.format('-')})", said, "'to'"), (0, name.format("_"), said, "'is'"), (0, f"concat({name.format('')}, '()')", said, "'on'"),
        (0, f"concat({name.format('.')}, '@mail', cast(id % 9 as string), '.example.com')", said, "'from'"), (0, f"concat(cast(2000 + id % 25 as string), '-0', cast(1 + id % 9 as string), '-11T10:', cast(10 + id % 50 as string), ':00.000000')", said, "'the'"),
        (0, f"concat(repeat(element_at(array('ab1','x','-=1','lorem2'), cast(id % 4 + 1 as int)), 7))", f"concat({key}, ' =')", "'here'"),
        # given values, short ones and such of one kind of character, and words that stand where a value might
        (1, f"concat({key}, '=', substr({mix}, 1, 8 + cast(id % 8 as int)))", said, "'on'"), (1, f"substr({mix}, 1, 9 + cast(id % 9 as int))", f"concat({key}, ' =')", "'and'"), (1, f"concat({key}, ':', translate(substr({h}, 1, 12 + cast(id % 14 as int)), '0123456789', 'ghijklmnop'))", said, "'of'"),
        (1, f"concat({key}, '=', {name.format('')}, cast(id % 89 as string), '!')", said, "'to'"), (1, f"concat({key}, ':\"', substr({up}, 1, 4), '-', substr({mix}, 1, 14), '$')", said, "'is'"), (1, f"concat('eyJ', substr({mix}, 1, 20), '.eyJ', substr({mix}, 5, 30), '.', substr({mix}, 2, 28))", said, "'and'"),
        (0, f"element_at(array('required','optional','protected','described','expired','invalid','yourself','generated'), cast(id div 3 % 8 + 1 as int))", f"concat({key}, ':')", "'in'"), (0, f"concat({key}, '=<your-', {key}, '>')", said, "'with'"), (0, f"concat({key}, ':', {name.format('.')}, '.get()')", said, "'the'"),
        (0, f"concat('data:image/png;base64,iVBORw0KGgo', {mix}, {mix})", "'src ='", "'alt'"), (0, f"concat('sha512-', {mix}, {mix}, '==')", "element_at(array('integrity','checksum','resolved','digest'), cast(id % 4 + 1 as int))", "'dev'"),
    ]
    names = [r.word for r in lexicon.words.where("length(word) >= 4").orderBy(F.xxhash64("word"), "word").limit(NAMES).collect()] if lexicon else []
    if len(names) > 20:
        one = lambda n: f"element_at(array({', '.join(repr(w) for w in names)}), cast(id * {n} % {len(names)} + 1 as int))"
        made += [
            (0, f"concat({one(1)}, '_', {one(7)}, '_', {one(11)}, cast(id % 31 as string))", said, "'the'"), (0, f"concat('/', {one(3)}, '/', {one(5)}, '/', {one(13)}, '-', cast(id as string))", said, "'and'"),
            (0, f"concat({one(17)}, initcap({one(19)}), initcap({one(23)}), cast(id % 7 as string))", said, "'is'"), (0, one(29), f"concat({key}, ':')", one(31)),
        ]
    each = -(-min(count, FIT_FINDINGS) // len(made))
    parts = [f"select {word} as word, split({before}, ' ') as b, {after} as after1, {label} as label from range(0, {each}, 1, 1)" for label, word, before, after in made]
    rows = spark.sql(" union all ".join(parts)).coalesce(1)
    return rows.select("word", F.try_element_at("b", F.lit(-2)).alias("before2"), F.element_at("b", -1).alias("before1"), "after1", "label")


def train(findings: DataFrame, lexicon: Lexicon, seed: int = 7) -> RandomForestClassificationModel:
    """The forest for labelled findings (word, before2, before1, after1, label); more than FIT_FINDINGS are cut to those of the least hash."""
    rows = stored(findings.orderBy(F.xxhash64("word", "before1", "label"), "word").limit(FIT_FINDINGS), f"{scratch(findings.sparkSession, 'findings')}/labelled")
    rows = features(first_values(rows), lexicon).select(*FEATURES, "word", F.col("label").cast("double").alias("label")).coalesce(1).sortWithinPartitions("word", "label")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scored(rows: DataFrame, model: RandomForestClassificationModel, lexicon: Lexicon) -> DataFrame:
    """Adds score to candidates."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows, lexicon))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def scan(documents: DataFrame, model: RandomForestClassificationModel, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """doc_id, place, value, score of each finding whose score is least or more.

    place: the word, counted from 0 between runs of blanks; a word may hold several findings. Null and empty texts have none. Rows with a null doc_id keep it; repeated rows repeat their findings, and rows that
    tie in all have the same score; an empty table gives none. Other columns of documents, whatever their names, are
    ignored. Texts are read in one narrow pass; only candidates are shuffled, to look their parts up.
    """
    rows = stored(candidates(documents), f"{scratch(documents.sparkSession, 'candidates')}/rows")
    return scored(rows, model, lexicon).where(F.col("score") >= least).select("doc_id", F.col("place").cast("long").alias("place"), "value", "score")
