"""Secret scans: a random forest that removes false positives.

Main path in DataFrame functions and Spark ML, all inside the JVM. Candidates are long runs of
key characters with a digit, values of 8 characters or more given to a name such as password (quoted or
bare, the name alone or part of a longer one), passwords in URLs, and private key blocks. A text is split at its candidates, so each comes with the text before
and after it, and redaction is the pieces joined again; no position is searched for.
The forest sees length, character transitions, the share of the candidate that
dictionary words cover, the path (the source), and neighbouring words. It is trained from the
labelled findings of `labelled_findings()`, a table made by rule (`per_template` rows for each
of its templates, which bounds it), or from a table of the caller's.

Only texts with candidates are taken apart; only decisions are shuffled in the scan. In
redact(), texts without candidates pass as they are, the others are joined with their decisions.

Defined results: a null or empty text has no findings; a null source is an empty path; repeated
rows are each reported; a candidate of any length is judged whole; an
empty table gives an empty result. The result never holds a candidate, only its digest. Other
columns of the input are left alone and can have any name.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.session import table, written

# Names that credentials go by, and the shapes of candidates.
_NAMES = r"(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
_RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
# A name can be part of a longer one (DB_PASSWORD, token_value), the value quoted or, as in .env and YAML, bare up to white space.
_SET = r"[\"']?\s{0,2}(?::=|=>|[:=])\s{0,2}"
_BEFORE = rf"(?<=[:=>]\s{{0,2}}[\"']?)(?<={_NAMES}\w{{0,64}}{_SET}"
_GIVEN = rf"(?i:{_BEFORE}[\"'])[^\"'\s]{{8,}}+(?=[\"'])|{_BEFORE})[^\"'\s:=>][^\"'\s]{{6,}}[^\"'\s,;.)&])"
_USERINFO = r"(?<=:)(?<=://[^\s:/@\"']{0,64}:)[^\s/\"']{3,}(?=@)"
_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]++-----END [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = f"{_BLOCK}|{_GIVEN}|{_USERINFO}|{_RUN}"
_MAY_BE_GIVEN = rf"(?i){_NAMES}\w{{0,64}}{_SET}[\"']?[^\"'\s]{{8}}"
_MAY_BE_USERINFO = r"://[^\s:/@\"']{0,64}:[^\s/\"']{3,}@"
# Words that names, paths and placeholders are made of.
DICTIONARY = (
    "access account action address admin agent alpha answer array asset author backup base before beta block body bucket build button cache change chapter check class client cloud code color "
    "column commit common component config content context control count create current data database date default delete demo design detail device digest document domain download dummy email "
    "enable entry error event example export false feature field file filter final first folder form format frame function global group handler hash header hidden home host image import "
    "index info inner input insert install item key label large last layer left level library license light limit link list local lock login main manager member menu message method mobile "
    "model module native network node number object offset option order output package page panel parent part password path pattern phone placeholder plain plugin point policy port position "
    "price private product profile project proxy public query queue random reader record release remote report request resource response result root route sample schema screen script search "
    "secret section select sender server service session setting simple single size source stage start state static storage store stream string style summary support switch system table target task temp test text token user value your"
).split()
_WORDS_IN = "(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
_CONTEXT = 64
MASK = "[SECRET]"
FEATURES = [
    "length", "distinct", "digits", "upper", "lower", "symbols", "transitions", "vowel_steps", "longest_digits", "longest_letters", "hex_only", "digits_only", "uuid", "known_prefix",
    "dictionary", "path_test", "path_code", "near_name", "given", "quoted", "near_hash", "near_url", "near_id", "letters_before", "userinfo", "code",
]
THRESHOLD = 0.5
#: Bound of the labelled rows that a forest is fitted on.
MOST_FINDINGS = 100_000


def may_have_candidates(text: Column) -> Column:
    return F.coalesce(text.rlike(_RUN) | text.rlike(_MAY_BE_GIVEN) | text.rlike(_MAY_BE_USERINFO) | text.contains("PRIVATE KEY-----"), F.lit(False))


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _longest(value: Column, pattern: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit(pattern), 0), F.length)), F.lit(0)).cast("double")


def featured(found: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of value, before, after and path."""
    v, before, after, path = F.col("value"), F.col("before"), F.col("after"), F.lower(F.coalesce(F.col("path"), F.lit("")))
    near = F.lower(before)
    changes = F.regexp_count(v, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])"))
    return found.withColumns(
        {
            "length": F.log1p(F.length(v)),
            "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.greatest(F.least(F.length(v), F.lit(64)), F.lit(1)),
            "digits": _share(v, "[0-9]"),
            "upper": _share(v, "[A-Z]"),
            "lower": _share(v, "[a-z]"),
            "symbols": _share(v, "[^A-Za-z0-9]"),
            "transitions": changes / F.greatest(F.length(v), F.lit(1)),
            "vowel_steps": _share(v, "[aeiouAEIOU](?=[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ])"),
            "longest_digits": _longest(v, "[0-9]+"),
            "longest_letters": _longest(v, "[A-Za-z]+"),
            "hex_only": _flag(v.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "digits_only": _flag(v.rlike(r"^[0-9]+$")),
            "uuid": _flag(v.rlike(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
            "known_prefix": _flag(v.rlike(r"^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abps]-|sk[-_]|pk_live_|eyJ|-----BEGIN)")),
            "dictionary": 1 - F.length(F.regexp_replace(F.lower(v), _WORDS_IN, "")) / F.greatest(F.length(v), F.lit(1)),
            "path_test": _flag(path.rlike("test|example|sample|mock|fixture|demo|doc")),
            "path_code": _flag(path.rlike(r"\.(?:py|js|ts|java|go|rb|php|ya?ml|env|ini|conf|json|sh)$")),
            "near_name": _flag(near.rlike(rf"\b\w{{0,20}}{_NAMES}\w{{0,20}}\W{{0,12}}(?:bearer\s)?$")),
            "given": _flag(before.rlike(r"[:=]\s{0,3}[\"']?$")),
            "quoted": _flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
            "near_hash": _flag(near.rlike(r"\b(?:sha\d*|md5|hash|commit|checksum|digest|revision|etag|integrity|blob|tree)\b\W{0,12}(?:\w+\W{1,3}){0,2}$")),
            "near_url": _flag(before.rlike(r"[/@?&#.\\]$|https?:\S*$") | after.rlike(r"^[/.@]")),
            "near_id": _flag(near.rlike(r"\b\w{0,20}(?:id|uuid|guid|number|no|card|account|phone|isbn|serial|order|version|date|build)\b\W{0,12}$")),
            "letters_before": _share(near, "[a-z]"),
            "userinfo": _flag(before.rlike(r"://[^\s/@]*:$") & after.rlike("^@")),
            "code": _flag(v.rlike(r"[(){}<>\[\]$]")),
        }
    )


# Fixed values: (label, before, value, after) of what labelled findings look like. A value is made of parts: a text, or
# ("name",), ("name", start, length) or ("name", start, length, case) of the values generated for a row.
_HEX40, _HEX32, _HEX64, _B64, _UUID, _A, _B, _C = ("hex40",), ("hex32",), ("hex64",), ("b64",), ("uuid",), ("a",), ("b",), ("c",)
TEMPLATES = [
    (1, 'token = "', [_HEX40], '"'), (1, 'TOKEN = "', [("hex40", 1, 40, "upper")], '"'), (1, "secret: ", [_HEX32], "\n"), (1, 'api_key="', [("alnum", 1, 32)], '"'), (1, "apiKey: '", [("alnum", 5, 24)], "',"),
    (1, "aws_access_key_id = ", ["AKIA", ("hex64", 1, 16, "upper")], "\n"), (1, "export SECRET=", [("b64", 1, 40)], "\n"), (1, "use ", ["ghp_", ("alnum", 1, 36)], " for it"),
    (1, 'password = "', [("alnum", 1, 6), "!", ("alnum", 9, 5)], '"'), (1, "Authorization: Bearer ", [("alnum", 1, 48)], "\n"), (1, "auth_token=", [_HEX64], "&"),
    (1, "slack ", ["xoxb-", ("digits", 1, 12), "-", ("alnum", 1, 24)], " "), (1, "key ", ["sk_live_", ("alnum", 1, 24)], "."),
    (1, "", ["-----BEGIN PRIVATE KEY-----\n", _B64, "\n-----END PRIVATE KEY-----"], "\n"), (1, 'token = "', [_HEX40], '"###'), (1, "token='", [("alnum", 1, 20), "-", ("alnum", 21, 10)], "'"),
    (1, 'DB_PASSWORD="', [("short",)], '"'), (1, "SECRET_VALUE='", [("alnum", 3, 9)], "'"), (1, 'my_token = "', [("phrase",)], '"'), (1, "PASSWORD=", [("numbered",)], "\n"), (1, "  password: ", [("short",)], "\n"), (1, "APP_SECRET=", [("alnum", 1, 12)], "\n"),
    (1, "DB_PASSWD: ", [("numbered",)], "\n"), (1, "postgres://app:", [("short",)], "@db.internal:5432/x"), (1, "mysql://root:", [("numbered",)], "@10.0.0.2/x"), (1, "https://user:", [("alnum", 2, 20)], "@host.net/"), (1, "amqp://svc:", [("phrase",)], "@mq"),
    (0, "self.token = ", ["get_", _A, "(request"], ")\n"), (0, "token = ", [_A, ".", _B, ".", _C], "\n"), (0, "PASSWORD=", ["${", ("a", 1, 99, "upper"), "_", ("b", 1, 99, "upper"), "}"], "\n"),
    (0, "the secret: ", [("said",)], " of it"), (0, "no token: ", [("said",)], " and then"), (0, "the password: ", [("said",)], ", but"), (0, "token: ", ["<your-", _A, ">"], "\n"), (0, "the secret: ", [_A, _B], " of it"), (0, "Author: ", [("a", 1, 99, "first"), "-", ("b", 1, 99, "first")], " and"), (0, 'password = "', ["enter_", _A, _B], '"'),
    (0, "https://user:", ["password"], "@host/"), (0, "commit ", [_HEX40], "\n"), (0, "sha256:", [_HEX64], " "), (0, "md5 ", [_HEX32], " "), (0, "request id ", [_UUID], " "), (0, "", [_UUID], ","), (0, "number ", [("digits", 1, 16)], " "), (0, " ", [("digits", 1, 16)], " and"),
    (0, "card ", [("digits", 1, 16)], ", "), (0, "", [("digits", 1, 18)], "\n"), (0, 'token = "', ["your_", _A, "_token_", ("digits", 1, 2)], '"'),
    (0, 'password = "', ["example_", _A, "_1234"], '"'), (0, "secret = '", [_A, "-", _B, "-placeholder-1"], "'"), (0, 'token = "', ["xxxxxxxxxxxxxxxx0000"], '"'),
    (0, "see /", [_A, "/", _B, "/20", ("digits", 3, 2), "/", _C], "."), (0, "https://example.com/", [_A, "-", _B, "-", _C, "-", ("digits", 1, 3)], " "),
    (0, "call ", [_A, "_", _B, "_", _C, "_v2"], "("), (0, "on ", ["20", ("digits", 3, 2), "-01-02T03-04-05"], " "), (0, "version ", ["release-20", ("digits", 3, 2), "-", ("hex32", 1, 7)], " "),
    (0, "etag: ", [_HEX32], "\n"), (0, "blob ", [("hex64", 1, 40)], "\t"), (0, "data:image/png;base64,", [_B64], ")"), (0, "isbn ", ["978-", ("digits", 1, 12)], " "),
    (0, "", [_A, _B, _C, ("digits", 1, 2)], " "), (0, "the ", [_A, "-", _B, "-", _A, "-20", ("digits", 3, 2)], " "), (0, 'checksum = "', [_HEX64], '"'), (0, 'digest: "', [_HEX40], '"'),
    (0, 'id = "', [_UUID], '"'),
]
# What stands before the finding, words of a made-up password, words of prose.
_LEADS = ["the note of ", "see also the part on ", "et pour la suite ", "und der text ", "en la casa ", "", "config:\n", "line | "]
_FREE = "purple monkey dragon sunset winter guitar coffee tiger river silver orange jungle castle rocket falcon hammer pepper violet marble anchor".split()
_SAID = "everyone yesterday sometimes different important otherwise anything whatever together children possible probably remember question building thousand mountain evidence although somebody".split()
_KINDS = "array<struct<template:int,label:double,before:string,after:string,parts:array<struct<name:string,text:string,start:int,length:int,form:string>>>>"


def _templates() -> Column:
    """TEMPLATES as an array of structs, read from one JSON text: a value of the plan, not code made for each template."""
    part = lambda p: {"text": p} if isinstance(p, str) else dict(zip(("name", "start", "length", "form"), (*p, *(1, 1 << 30, "")[len(p) - 1 :]), strict=True))
    return F.from_json(F.lit(json.dumps([{"template": t, "label": y, "before": b, "after": a, "parts": [part(p) for p in v]} for t, (y, b, v, a) in enumerate(TEMPLATES)])), _KINDS)


def labelled_findings(spark: SparkSession, per_template: int = 120) -> DataFrame:
    """Labelled findings (label, value, before, after, path, template), `per_template` for each template."""
    i = F.col("id").cast("string")
    drawn = lambda words, salted: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(salted), F.lit(len(words))) + 1).cast("int"))
    word = lambda words, k: drawn(words, F.concat(i, F.lit(k)))
    made = spark.range(per_template).select(
        "id",
        drawn(_LEADS, F.concat(F.lit("p"), i)).alias("lead"),
        F.when(F.pmod(F.xxhash64(i), F.lit(5)) == 0, F.lit("src/app.py")).otherwise(F.concat(F.lit("src"), F.substring(F.lpad(F.abs(F.xxhash64(i)).cast("string"), 19, "7"), 1, 1))).alias("path"),
        *[f.alias(n) for n, f in (("hex40", F.sha1(i)), ("hex32", F.md5(i)), ("hex64", F.sha2(i, 256)), ("b64", F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i), 512)))), ("digits", F.lpad(F.abs(F.xxhash64(i)).cast("string"), 19, "7")))],
        *[word(DICTIONARY, k).alias(k) for k in "abc"], *[word(_FREE, k).alias(k) for k in "xyz"], word(_SAID, "w").alias("said"), drawn("!@$#%", i).alias("mark"), (F.pmod(F.xxhash64(i), F.lit(2)) == 0).alias("even"),
    )
    made = made.withColumns({"alnum": F.regexp_replace("b64", "[+/=]", ""), "uuid": F.regexp_replace("hex32", "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")})
    made = made.withColumns(
        {
            "short": F.concat(F.substring("alnum", 1, 5), "mark", F.substring("alnum", 9, 4)),
            "phrase": F.concat("x", "y", "z"),
            "numbered": F.concat("x", F.substring("digits", 1, 1), F.when(F.col("even"), F.col("a")).otherwise(F.col("y"))),
        }
    )
    names = ["hex40", "hex32", "hex64", "b64", "digits", "alnum", "uuid", "a", "b", "c", "said", "short", "phrase", "numbered"]
    values = made.select("lead", "path", F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))]).alias("made")).withColumn("k", F.explode(_templates()))

    def text(p: Column) -> Column:
        v = F.element_at("made", p["name"]).substr(p["start"], p["length"])
        return F.when(p["name"].isNull(), p["text"]).when(p["form"] == "upper", F.upper(v)).when(p["form"] == "first", F.initcap(v)).otherwise(v)

    return values.select("k.label", F.array_join(F.transform("k.parts", text), "").alias("value"), F.concat("lead", "k.before").alias("before"), "k.after", "path", "k.template")


def train(findings: DataFrame, trees: int = 40, depth: int = 9, seed: int = 11, most: int = MOST_FINDINGS) -> RandomForestClassificationModel:
    """A forest from labelled findings (label, value, before, after, path), of which the `most` least by a hash are taken; the same for the same rows."""
    some = findings.select("label", "value", "before", "after", "path").orderBy(F.xxhash64("label", "value", "before", "after", "path"), "value", "before", "after", "path").limit(most)
    # A bounded table: written once, so the passes of the training read features, and in one order.
    rows = written(featured(some).select("label", *FEATURES), "findings").repartition(1).sortWithinPartitions("label", *FEATURES)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def findings(docs: DataFrame, keys: list[str], text: Column, path: Column) -> DataFrame:
    """(keys, ordinal, value, before, after, path) of every candidate."""
    rest = F.split(text, CANDIDATE)
    # Arrays are arguments of transform(), not columns in its body: there they would be made anew for each element.
    split = docs.where(may_have_candidates(text)).select(*keys, path.alias("path"), F.arrays_zip(F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("value"), rest.alias("before"), F.slice(rest, 2, 1 << 30).alias("after")).alias("zipped"))
    context = F.transform(
        F.filter("zipped", lambda x: x["value"].isNotNull()),
        lambda x, i: F.struct(i.alias("ordinal"), x["value"].alias("value"), F.right(x["before"], F.lit(_CONTEXT)).alias("before"), F.substring(x["after"], 1, _CONTEXT).alias("after")),
    )
    return split.select(*keys, "path", F.explode(context).alias("x")).select(*keys, "x.ordinal", "x.value", "x.before", "x.after", "path")


def classified(found: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """Adds `probability`, that the candidate is a secret."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(featured(found))
    forest = forest.setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y")
    return forest.transform(rows).select(*found.columns, F.get(vector_to_array("_p"), F.lit(1)).alias("probability"))


def scan(docs: DataFrame, forest: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each candidate: its document, place among the document's candidates, digest, probability and verdict."""
    found = findings(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(path_col).alias("_path")), ["_id"], F.col("_text"), F.col("_path"))
    done = classified(found, forest)
    return done.select(F.col("_id").alias("doc_id"), F.col("ordinal").cast("int").alias("ordinal"), F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """`docs` with the secrets of each text replaced by `mask`."""
    text = F.col(text_col)
    maybe = may_have_candidates(text)
    some = docs.where(maybe).withColumns({"_id": F.col(id_col).cast("string"), "_tag": F.xxhash64(text, F.col(path_col))})
    found = findings(some, ["_id", "_tag"], text, F.col(path_col))
    bad = classified(found, forest).where(F.col("probability") >= threshold).groupBy("_id", "_tag").agg(F.collect_set("ordinal").alias("_bad")).withColumnsRenamed({"_id": "_id2", "_tag": "_tag2"})
    joined = some.join(bad, some["_id"].eqNullSafe(bad["_id2"]) & (some["_tag"] == bad["_tag2"]), "left")
    zipped = F.arrays_zip(F.split(text, CANDIDATE).alias("rest"), F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("value"))
    parts = F.transform(zipped, lambda x, i: F.concat(x["rest"], F.when(F.array_contains("_bad", i), F.lit(mask)).otherwise(F.coalesce(x["value"], F.lit("")))))
    changed = joined.withColumn(text_col, F.when(F.col("_bad").isNull(), text).otherwise(F.array_join(parts, "")))
    return docs.where(~maybe).unionByName(changed.select(docs.columns))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document, and whether it is a secret."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), train(labelled_findings(spark)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars made anew for these."""
    done = redact(docs, train(labelled_findings(spark)))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
