"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

A text is cut at its candidates, which gives each one the text before (earlier candidates with it) and after it.  A forest, trained
from labelled findings, judges a candidate by its length, its changes between kinds of characters, the
share of it that dictionary words cover, its path and its neighbouring words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN, _PEM = r"[A-Za-z0-9+/_\-]", r"[A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
_NAME = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|key|auth|authorization|credentials?)(?:[sS]|[_\-0-9A-Z][A-Za-z0-9_\-]{0,24})?"
_SCHEME = r"(?i:bearer|basic|token)"
#: A private key to its END line (without one, its header and the encoded lines after it), a run of token
#: characters with a digit or with letters of both cases in it, or what a password, token or key is set to.
CANDIDATE = (
    rf"-----BEGIN {_PEM}(?:(?:[^\-]++|-(?!----(?:BEGIN|END) ))*+-----END {_PEM}|(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{{16,}}+)*+)"
    rf"|(?<!{_RUN})(?={_RUN}{{16}})(?=[A-Za-z+/_\-]*+[0-9]|(?=[A-Z+/_\-]*+[a-z])[a-z+/_\-]*+[A-Z]){_RUN}{{16,}}+={{0,2}}"
    rf"|(?<=[:=>][ \t]{{0,4}}[\"']?|{_SCHEME} {{1,2}})(?<={_NAME}[\"']?[ \t]{{0,4}}(?:=>|[:=]{{1,2}})[ \t]{{0,4}}[\"']?(?:{_SCHEME} {{1,2}})?)(?!{_SCHEME}\s)[^\s\"']{{6,}}+"
)
#: What every candidate needs, and is found faster: a long run, or in lower case a key's or a name's letters.
LONG_RUN, NAMES = rf"(?<!{_RUN}){_RUN}{{16}}", ("private key", "passw", "passphrase", "pwd", "secret", "token", "key", "auth", "credential")
#: Fewest characters of a candidate.
LEAST = 6
BEFORE, AFTER = 48, 24
#: Candidates of a text whose positions are counted together.
STRETCH = 256
#: Common words and placeholder words, longest first where one holds another.
DICTIONARY = (
    "placeholder|changeme|password|example|default|company|service|message|account|private|version|release|number|secret|sample|config|public|string|simple|system|server|client|module|update|"
    "dummy|token|value|local|guide|index|image|table|there|which|their|about|would|other|these|after|could|first|where|world|file|test|data|user|name|main|page|code|time|type|with|from|have|this|"
    "that|your|here|http|html|json|path|key|abc|xyz|xxx|foo|bar|the|and|for|not|you|all|can|one|out|get|set|new|old|www|com|org|img|src|lib|bin|ing|ion|ent|est|ous|ive|ere|are|ter|ver|con|pre|pro|com"
)
#: The most frequent letter pairs of English.
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le"
FEATURES = ("log_length", "changes", "pairs", "distinct", "digits", "uppers", "symbols", "hex", "words", "slashes", "path", "keyword", "digest_word", "assigned", "quoted", "header")
TREES, DEPTH, SEED = 40, 8, 7


def _share(count: Column, of: Column) -> Column:
    return count / F.greatest(F.length(of), F.lit(1))


def features(rows: DataFrame) -> DataFrame:
    """``rows`` (candidate, before, after, path) plus one double column for each of ``FEATURES``; nulls count as empty."""
    c, before, after, path = (F.coalesce(F.col(k), F.lit("")) for k in ("candidate", "before", "after", "path"))
    low, count = F.lower(c), lambda of, pattern: F.regexp_count(of, F.lit(pattern))
    flag = lambda of, pattern: of.rlike(pattern).cast("double")
    columns = {
        "log_length": F.log1p(F.length(c).cast("double")),
        "changes": _share(count(c, r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"), c),
        "pairs": _share(count(low, rf"(?=(?:{PAIRS}))[a-z]"), c),
        "distinct": _share(F.size(F.array_distinct(F.split(c, ""))), c),
        "digits": _share(count(c, "[0-9]"), c),
        "uppers": _share(count(c, "[A-Z]"), c),
        "symbols": _share(count(c, "[^A-Za-z0-9]"), c),
        "hex": flag(low, r"^[0-9a-f]+$"),
        "words": 1 - _share(F.length(F.regexp_replace(low, DICTIONARY, "")), c),
        "slashes": _share(count(c, "/"), c) + flag(before, r"[/.:]$") + flag(before, r"(?i)https?://[^\s]*$"),
        "path": flag(path, r"(?i)test|mock|fixture|example|sample|docs?/"),
        "keyword": flag(before, r"(?i)key|token|secret|passw|pwd|auth|bearer|credential|access|api"),
        "digest_word": flag(before, r"(?i)\b(?:sha-?\d*|md5|commit|hash|checksum|digest|integrity|revision|uuid|guid|build|etag|blob|id)\b[^\n]{0,12}$"),
        "assigned": flag(before, r"[=:]\s*[\"']?$"),
        "quoted": flag(before, r"[\"']$") * flag(after, r"^[\"']"),
        "header": flag(c, r"^-----BEGIN|^(?:AKIA|ASIA|ghp_|gho_|xox[abprs]-|sk-|AIza|eyJ|glpat-)"),
    }
    return rows.withColumns({k: v.cast("double") for k, v in columns.items()})


def labelled_findings(spark: SparkSession, per_shape: int = 400) -> DataFrame:
    """A table of labelled findings ``(candidate, before, after, path, label)``, made by rule from row numbers.

    Label 1: random values that something is set to or authorised with.  Label 0: digests, revisions,
    identifiers, paths, encoded data and placeholders, some of them in just such places.
    """
    n = F.col("id")
    hexes = lambda salt, k: F.substring(F.sha2(F.concat(n.cast("string"), F.lit(salt)), 256), 1, k)
    b64 = lambda salt, k: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(n.cast("string"), F.lit(salt)), 512))), "[+/=\r\n]", "x"), 1, k)
    word = lambda salt: F.element_at(F.split(F.lit(DICTIONARY), r"\|"), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(70)) + 1).cast("int"))
    pick = lambda salt, *options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    filler = F.concat(word("f1"), F.lit(" "), word("f2"), F.lit(" "))
    named = F.concat(filler, pick("n", "token", "api_key", "API_KEY", "secret", "auth_token", "access_key", "TOKEN", "client_secret", "key"), pick("e", " = ", "=", ": ", " := "), F.lit('"'))
    bearer = F.concat(filler, pick("b", "Authorization: Bearer ", "token ", "key=", "secret: "))
    digest = F.concat(filler, pick("d", "commit ", "sha256: ", "sha1 ", "md5=", "checksum: ", "hash ", "revision ", "integrity=", "etag: ", "build "), pick("q", "", '"'))
    letters = lambda salt, k: F.substring(F.translate(b64(salt, 64), "0123456789", "KqZwXvJyBg"), 1, k)
    many = lambda k, one, gap="": F.array_join(F.transform(F.sequence(F.lit(1), F.lit(k)), one), gap)
    prose = lambda salt, k: many(k, lambda i: F.element_at(F.array(*map(F.lit, PAIRS.split("|"))), (F.pmod(F.xxhash64(n, F.lit(salt), i), F.lit(30)) + 1).cast("int")))
    spoken = F.concat(filler, pick("o", "token: ", "Password: ", "key: ", "auth: ", "secret = ", "Token: "))
    line = lambda i: F.substring(F.base64(F.unhex(F.sha2(F.concat_ws(" ", n, i), 512))), 1, 64)
    pem = lambda kind, lines: F.concat(F.lit(f"-----BEGIN {kind}PRIVATE KEY-----\n"), many(lines, line, "\n"), F.lit(f"\n-----END {kind}PRIVATE KEY-----"))
    code, test, any_path = pick("p", "app/settings", "deploy", "lib/client", ""), pick("t", "tests/fixtures", "docs/example", "mock/data"), pick("a", "docs/guide", "lib/core", "tests/unit", "")
    shapes = [
        (hexes("h", 40), named, '"', code, 1), (hexes("i", 32), named, '"', code, 1), (hexes("j", 64), bearer, "\n", code, 1), (b64("k", 40), named, '"', code, 1), (b64("l", 36), bearer, " ", code, 1),
        (F.upper(hexes("u", 40)), named, '"', code, 1), (F.concat(F.lit("AKIA"), F.upper(hexes("m", 16))), named, '"', any_path, 1), (F.concat(F.lit("ghp_"), b64("o", 36)), filler, " ", any_path, 1),
        (F.concat(F.lit("sk-"), b64("s", 40)), bearer, " ", any_path, 1), (F.lit("-----BEGIN RSA PRIVATE KEY-----"), filler, "\n", any_path, 1), (F.concat(b64("w", 9), F.lit("!7")), F.concat(filler, F.lit('password = "')), '"', code, 1),
        (hexes("d", 40), digest, " ", any_path, 0), (hexes("c", 64), digest, '"', any_path, 0), (hexes("g", 32), F.concat(filler, F.lit("id ")), " ", any_path, 0), (b64("v", 44), F.concat(filler, F.lit("data:image/png;base64,")), "\n", any_path, 0),
        (F.concat(word("1"), F.lit("_"), word("2"), F.lit("_"), word("3"), F.lit("_"), word("4"), F.lit("1")), named, '"', any_path, 0), (F.concat(word("5"), F.lit("/"), word("6"), F.lit("/"), word("7"), F.lit("-"), word("8"), F.lit("2024")), filler, " ", any_path, 0),
        (F.concat(F.lit("https"), F.lit("/"), word("9"), F.lit("/"), word("10"), F.lit("/"), hexes("z", 8), F.lit("/"), word("11")), F.concat(filler, F.lit("http://")), " ", any_path, 0),
        (F.concat(F.lit("xxxxxxxx"), word("12"), F.lit("xxxxxxxx0000")), named, '"', any_path, 0), (F.concat(F.lit("your-"), word("13"), F.lit("-key-here-"), F.lit("123")), named, '"', any_path, 0),
        (F.concat(hexes("x", 8), F.lit("-"), hexes("y", 4), F.lit("-"), hexes("r", 4), F.lit("-"), hexes("t", 12)), filler, " ", any_path, 0), (hexes("e", 40), named, '"', test, 0),
        (F.repeat(F.lit("0123456789"), 3), filler, " ", any_path, 0), (F.concat(word("14"), word("15"), word("16"), word("17"), word("18"), F.lit("7")), filler, " ", any_path, 0),
        (letters("L1", 20), named, '"', code, 1), (letters("L2", 32), bearer, " ", code, 1), (letters("L3", 16), named, '"', code, 1), (F.lower(letters("L4", 20)), named, '"', code, 1),
        (pem("RSA ", 4), filler, "\n", any_path, 1), (pem("", 16), filler, "\n", any_path, 1),
        (F.concat(word("20"), F.initcap(word("21")), F.initcap(word("22")), F.initcap(word("23"))), named, '"', any_path, 0), (F.concat(F.initcap(word("24")), F.initcap(word("25")), F.initcap(word("26")), F.initcap(word("27"))), filler, " ", any_path, 0),
        (F.initcap(prose("r", 9)), filler, " ", any_path, 0), (prose("s", 5), spoken, " ", any_path, 0), (F.concat(word("28"), word("29")), named, '"', any_path, 0), (F.concat(word("30"), F.lit("."), word("31"), F.lit("("), word("32"), F.lit(")")), named, "\n", any_path, 0),
        (F.concat(F.upper(word("33")), F.lit("_"), F.upper(word("34")), F.lit("_KEY_V2=")), filler, "", any_path, 0), (F.concat(F.lit("s3_"), word("35"), F.lit("_"), word("36"), F.lit("_key")), filler, "=", any_path, 0),
        (F.concat(F.lit("/"), F.initcap(word("37")), F.lit("/"), F.initcap(word("38")), F.lit("/"), word("39")), filler, " ", any_path, 0),
    ]
    made = F.explode(F.array(*[F.struct(c.alias("candidate"), b.alias("before"), F.lit(a).alias("after"), p.alias("path"), F.lit(float(y)).alias("label")) for c, b, a, p, y in shapes]))
    return spark.range(per_shape, numPartitions=1).select(made.alias("r")).select("r.*")


def train(findings: DataFrame) -> PipelineModel:
    """A forest from labelled findings ``(candidate, before, after, path, label)``."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return PipelineModel([assembler, forest.fit(assembler.transform(features(findings)))])


def may_hold(text_col: str) -> Column:
    """Whether a text may hold a candidate; most texts can't, and the pattern itself is slow."""
    low = F.lower(text_col)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in NAMES], F.col(text_col).rlike(LONG_RUN))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(doc_id, text_hash, nth, start, candidate, before, after, path)`` of every candidate of every row; ``start`` counts characters from 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path")).filter(may_hold("text")).filter(F.col("text").rlike(CANDIDATE))
    cut = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("text", CANDIDATE, -1).alias("p"))
    index = F.sequence(F.lit(0), F.size("c") - 1)
    cut = cut.withColumn("l", F.zip_with(F.slice("p", 1, F.size("c")), "c", lambda p, c: F.length(p) + F.length(c)))
    # Where each stretch of STRETCH candidates begins; within one, lengths are added up, so that no text costs the square of its candidates.
    total = lambda at, n: F.aggregate(F.slice("l", at + 1, n), F.lit(0), lambda s, x: s + x)
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size("c") - 1) / STRETCH).cast("int")), lambda k: total(k * STRETCH, F.lit(STRETCH)))
    cut = cut.withColumn("o", F.aggregate(
        sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
    )["all"])
    stretch = lambda i: F.floor(i / STRETCH).cast("int")
    starts = F.transform(index, lambda i: F.get("o", stretch(i)) + total(stretch(i) * STRETCH, i % STRETCH) + F.length(F.get("p", i)))
    tail = lambda x: F.substr(x, F.greatest(F.length(x) - BEFORE + 1, F.lit(1)))
    reach = -(-BEFORE // LEAST)
    joined = lambda i: F.concat(F.array_join(F.slice("t", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), ""), F.get("p", i))
    cut = cut.withColumn("t", F.zip_with(F.slice("p", 1, F.size("c")), "c", lambda p, c: F.concat(tail(p), tail(c))))
    around = F.arrays_zip(F.col("c"), F.transform(index, lambda i: tail(joined(i))).alias("b"), F.transform(F.slice("p", 2, F.size("c")), lambda x: F.substring(x, 1, AFTER)).alias("a"), starts.alias("s"))
    return cut.select("doc_id", "text_hash", "path", F.posexplode(around)).select("doc_id", "text_hash", F.col("pos").alias("nth"), F.col("col.s").cast("long").alias("start"), F.col("col.c").alias("candidate"), F.col("col.b").alias("before"), F.col("col.a").alias("after"), "path")


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", with_path: bool = False) -> DataFrame:
    """Every candidate of every row with the forest's probability ``score`` and the decision ``is_secret``.

    ``findings`` is the labelled table to learn from, by default the one made by rule.  Null and empty
    texts hold no candidate; repeated rows and null ids give a row each.  A null path is judged as an empty one,
    and comes back with its candidates if ``with_path``.
    """
    model = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    # A feature is named path, too.
    judged = model.transform(features(candidates(docs, id_col, text_col, path_col).withColumn("at_path", F.col("path")))).withColumn("path", F.col("at_path"))
    return judged.select("doc_id", "text_hash", *["path"] * with_path, "nth", "start", F.length("candidate").cast("long").alias("length"), "candidate", vector_to_array("probability")[1].alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def redacted(docs: DataFrame, findings: DataFrame | None = None, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark``; all other characters, rows and columns stay.

    Null and empty texts stay as they are; rows of one id, text and path, nulls included, are treated alike,
    while a path of its own may have the forest judge the same text otherwise.
    Columns may have any names but those that begin with ``__newsdesk``.  An empty table gives an empty result.
    """
    # Of a text with a secret, at its path: for each of its candidates, in order, whether it is one.
    alike = {"__newsdesk_id": "doc_id", "__newsdesk_hash": "text_hash", "__newsdesk_path": "path"}
    found = (
        scan(docs, findings, id_col=id_col, text_col=text_col, path_col=path_col, with_path=True)
        .groupBy(*[F.col(c).alias(k) for k, c in alike.items()], "nth").agg(F.max("is_secret").alias("is_secret"))
        .groupBy(*alike).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "is_secret"))), lambda x: x["is_secret"]).alias("__newsdesk_secret")).filter(F.exists("__newsdesk_secret", lambda x: x))
    )
    own = {"__newsdesk_id": F.col(id_col).cast("long"), "__newsdesk_hash": F.xxhash64(F.col(text_col).cast("string")), "__newsdesk_path": F.col(path_col).cast("string")}
    met = docs.join(found, reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(k)) for k, c in own.items()]), "left")
    pieces = F.arrays_zip(F.split(F.col(text_col), CANDIDATE, -1).alias("text"), F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0)).alias("candidate"))
    cut = F.transform(pieces, lambda p, i: F.concat(p["text"], F.when(p["candidate"].isNull(), "").when(F.get("__newsdesk_secret", i), mark).otherwise(p["candidate"])))
    return met.withColumn(text_col, F.when(F.col("__newsdesk_secret").isNotNull(), F.array_join(cut, "")).otherwise(F.col(text_col))).drop(*alike, "__newsdesk_secret")
